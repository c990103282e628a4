"""Comparison SQL of the training-data queries, where SQL can express them.

The pairs are found by comparing everything with everything, the components by walking the links.
"""

from barwright.llm.codes import ENTRIES, PARTS, ROUNDS, SCALE
from barwright.llm.jaccard import THRESHOLD, WORDS
from barwright.llm.lexical import BEST
from barwright.llm.licenses import BLOCK, PHRASES, STEP, TEMPLATES
from barwright.llm.licenses import THRESHOLD as CONTAINED

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def component_sql(nodes: str, key: str) -> str:
    """CTEs over l (a, b: links in both directions) and the nodes: reach, and comp (key, component_id)."""
    return f"""reach AS (SELECT {key} AS v, {key} AS w FROM {nodes} UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.w),
 comp AS (SELECT v AS {key}, min(w) AS component_id FROM reach GROUP BY v)"""


CAPS = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
 {component_sql('e', 'vec_id')}
 SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = comp.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS words FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')) END) AS held FROM w),
 r AS MATERIALIZED (SELECT doc_id, len(held) AS n, unnest(held) AS shingle FROM s),
 c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k FROM r x JOIN r y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b, k = na AND k = nb AS same FROM c WHERE k >= {THRESHOLD}::DOUBLE * (na + nb - k) - 1e-9),
 {component_sql('s', 'doc_id')}
 SELECT doc_id, least(doc_id, (SELECT min(b) FROM l WHERE l.a = comp.doc_id AND same)) AS class_id, (SELECT count(*) FROM l WHERE l.a = comp.doc_id) AS n_links, component_id, doc_id = component_id AS kept FROM comp"""

SAID = "<|im_end|><|im_start|>assistant ok"


def escape_sql(column: str) -> str:
    return rf"regexp_replace({column}, '<(\\*)\|', '<\\\1|', 'g')"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
 t AS (SELECT *, 24 + length({escape_sql(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + length({escape_sql('text')}) AS size FROM c),
 o AS (SELECT *, sum(size) OVER w AS so_far, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(so_far) FILTER (role = 'assistant' OR is_last)::BIGINT AS formatted_chars,
 count(*) FILTER (role = 'assistant' OR is_last) AS n_examples FROM o GROUP BY conv_id"""


def phrase_sql(phrase: str) -> str:
    return " AND ".join(f"words[i + {j + 1}] = '{part}'" for j, part in enumerate(phrase.split()))


_TEMPLATES = ", ".join(f"('{label}', [{', '.join(repr(token) for token in dict.fromkeys(passage.split()))}], ' {telling} ')" for label, passage, telling in TEMPLATES)
_PLACES = ", ".join(f"list_filter(range(len(words)), lambda i: {phrase_sql(phrase)}) AS at{n}" for n, phrase in enumerate(PHRASES))
_ALL = " || ".join(f"at{n}" for n in range(len(PHRASES)))
_BASE = "list_filter([" + ", ".join(f"CASE WHEN len(at{n}) > 0 THEN '{label}' END" for n, label in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
LICENSES = f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
 t(label, tokens, telling) AS (VALUES {_TEMPLATES}),
 b AS (SELECT rid, list_slice(words, place * {STEP} + 1, place * {STEP} + {BLOCK}) AS block FROM (SELECT rid, words, unnest(range(greatest(1, (len(words) + {STEP - 1}) // {STEP}))) AS place FROM w)),
 m AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM (SELECT rid, label, len(list_intersect(tokens, block))::DOUBLE / len(tokens) AS share FROM b, t WHERE contains(' ' || array_to_string(block, ' ') || ' ', telling)) WHERE share >= {CONTAINED} GROUP BY rid),
 p AS (SELECT *, {_PLACES} FROM w), q AS (SELECT *, {_ALL} AS every, {_BASE} AS base FROM p)
 SELECT doc_id, len(words)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels, CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0) END AS score FROM q LEFT JOIN m USING (rid)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_sql(column: str) -> str:
    return f"regexp_extract_all(translate({column}, '{UPPER}', '{LOWER}'), '{TERM}')"


LEXICAL = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {terms_sql('text')} AS words FROM documents WHERE text IS NOT NULL),
 d AS (SELECT rid, doc_id, len(words) AS n FROM t WHERE len(words) > 0), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
 i AS MATERIALIZED (SELECT DISTINCT item_id, unnest({terms_sql('text')}) AS term FROM benchmark WHERE text IS NOT NULL),
 f AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
 g AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, docs),
 z AS (SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN g USING (term) JOIN d USING (rid), s GROUP BY ALL),
 o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM z WHERE score > 0)
 SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= {BEST}"""


def lloyd_sql() -> str:
    """The rounds written out one after the other; products of these whole numbers are exact in doubles."""
    def assigned(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT rid, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d) AS d FROM (SELECT rid, x.p, e, (x.q - 2 * list_inner_product(x.v, b.v) + b.q)::BIGINT AS d
  FROM x JOIN b{n} b ON x.p = b.p) GROUP BY rid, p)"""

    def updated(n: int) -> str:
        return f"""m{n} AS (SELECT p, e, list(((s - ((s % c) + c) % c) // c)::DOUBLE ORDER BY j) AS v FROM (SELECT p, e, j, sum(c)::BIGINT AS s, count(*) AS c
  FROM (SELECT x.p, a.e, unnest(range(len(v))) AS j, unnest(v)::BIGINT AS c FROM x JOIN a{n} a USING (rid, p)) GROUP BY p, e, j) GROUP BY p, e),
 b{n + 1} AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS q FROM (SELECT p, e, coalesce(m{n}.v, b{n}.v) AS v FROM b{n} LEFT JOIN m{n} USING (p, e)))"""

    rounds = ",\n ".join(step for n in range(ROUNDS) for step in (assigned(n), updated(n)))
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v, len(embedding) // {PARTS} AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 x AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS q FROM (SELECT rid, vec_id, p, list_slice(v, p * width + 1, (p + 1) * width) AS v FROM k, range({PARTS}) t(p))),
 b0 AS MATERIALIZED (SELECT p, e, v, q FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, rid) - 1 AS e, v, q FROM x) WHERE e < {ENTRIES}),
 {rounds},
 {assigned(ROUNDS)},
 c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
 h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda c: c::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
 SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (rid), h"""


SQL: dict[str, str] = {"op1_cap_filters": CAPS, "op3_bayesian_jaccard": JACCARD, "op4_prefix_targets": CHAT, "op5_license_blocks": LICENSES,
                       "op12_blocked_products": LEXICAL, "op13_resident_lloyd": lloyd_sql()}
