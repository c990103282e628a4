"""Language identification by a byte convolutional network.

Method: a text becomes windows of a fixed number of bytes. Each byte has a learned vector; filters of several widths slide over
the window, the strongest response of each filter is kept (max pooling), and a softmax layer turns the responses into language
probabilities. Trained in numpy on labelled windows; a text's probabilities are the byte-weighted geometric mean over all its windows.

At prediction a filter of width w is a sum of table look-ups, one per pair of bytes, so no window is unrolled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.llm.common import batch_of, fresh, map_arrow

WIDTHS, FILTERS, DIMENSIONS = (2, 3, 4), 16, 8
# Bytes of one window; windows sent through the network together.
BYTES, TOGETHER = 256, 512
# The only bound of the method: labelled documents per language, and characters of one training passage.
PER_LANGUAGE, PASSAGE, MOST_LANGUAGES = 400, 1000, 200
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    bytes: np.ndarray                 # 256 x DIMENSIONS
    filters: list[np.ndarray]         # per width: width x DIMENSIONS x FILTERS
    shift: np.ndarray                 # one per filter
    weight: np.ndarray                # filters x languages
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Look-ups: first pair of bytes for all filters, third byte of width 3, second pair of width 4."""
        two, three, four = ([self.bytes @ slot for slot in kernel] for kernel in self.filters)
        pair = lambda left, right: (left[:, None, :] + right[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(*two), pair(*three[:2]), pair(*four[:2])], axis=1)
        return np.ascontiguousarray(first, dtype=np.float32), three[2].astype(np.float32), pair(*four[2:]).astype(np.float32)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x BYTES, text number of each, bytes of text in each); a short last window is filled with blanks."""
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    count = np.array([-(-len(one) // BYTES) for one in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(one.ljust(n * BYTES, b" ") for one, n in zip(raw, count.tolist())), dtype=np.uint8).reshape(-1, BYTES)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(BYTES, np.array([len(one) for one in raw], dtype=np.int64)[owner] - place * BYTES) if len(owner) else np.zeros(0, np.int64)
    return data, owner, length


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def train(texts: list[str], names: list[str], epochs: int = 3, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross-entropy with balanced languages. The gradient of a pooled filter reaches only its strongest position."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(names))
    data, owner, length = windows_of(texts)
    use = length >= min(64, BYTES)
    use = use if use.any() else length > 0
    data, target = data[use], np.array([languages.index(name) for name in names])[owner[use]]
    share = 1 / np.maximum(np.bincount(target, minlength=len(languages)), 1)
    importance = share[target] / share[target].mean()
    total = FILTERS * len(WIDTHS)
    at = {"bytes": rng.normal(0, 0.5, (256, DIMENSIONS)), "shift": np.zeros(total), "weight": rng.normal(0, 0.1, (total, len(languages))), "bias": np.zeros(len(languages))}
    at |= {f"filter{w}": rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    mean, square, step = {k: np.zeros_like(v) for k, v in at.items()}, {k: np.zeros_like(v) for k, v in at.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), 64):
            some = order[start:start + 64]
            codes = data[some]
            vectors = at["bytes"][codes]
            pooled, best = [], []
            for w in WIDTHS:
                response = sum(vectors[:, j:BYTES - w + 1 + j] @ at[f"filter{w}"][j] for j in range(w))
                best.append(response.argmax(axis=1))
                pooled.append(np.take_along_axis(response, best[-1][:, None, :], axis=1)[:, 0])
            pooled = np.concatenate(pooled, axis=1) + at["shift"]
            hidden = np.maximum(pooled, 0)
            error = softmax(hidden @ at["weight"] + at["bias"])
            error[np.arange(len(some)), target[some]] -= 1
            error *= importance[some][:, None] / len(some)
            slope = {"weight": hidden.T @ error, "bias": error.sum(axis=0)}
            back = (error @ at["weight"].T) * (pooled > 0)
            slope["shift"] = back.sum(axis=0)
            slope["bytes"] = np.zeros_like(at["bytes"])
            for i, w in enumerate(WIDTHS):
                own = back[:, i * FILTERS:(i + 1) * FILTERS]
                kernel = np.zeros_like(at[f"filter{w}"])
                for j in range(w):
                    code = np.take_along_axis(codes, best[i] + j, axis=1)
                    kernel[j] = np.einsum("nfd,nf->df", at["bytes"][code], own)
                    np.add.at(slope["bytes"], code, own[:, :, None] * at[f"filter{w}"][j].T[None])
                slope[f"filter{w}"] = kernel
            step += 1
            for name, value in slope.items():
                mean[name] = 0.9 * mean[name] + 0.1 * value
                square[name] = 0.999 * square[name] + 0.001 * value * value
                at[name] = at[name] - rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
    return Network(languages, at["bytes"], [at[f"filter{w}"] for w in WIDTHS], at["shift"], at["weight"], at["bias"])


def log_probabilities(data: np.ndarray, network: Network, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    first, third, second = tables
    pairs = data[:, :-1].astype(np.int32) << 8 | data[:, 1:]
    last = BYTES - max(WIDTHS) + 1
    f = FILTERS
    response = first[pairs]
    response[:, :BYTES - 2, f:2 * f] += third[data[:, 2:]]
    response[:, :last, 2 * f:] += second[pairs[:, 2:]]
    pooled = np.concatenate([response[:, :, :f].max(axis=1), response[:, :BYTES - 2, f:2 * f].max(axis=1), response[:, :last, 2 * f:].max(axis=1)], axis=1)
    scores = np.maximum(pooled + network.shift, 0) @ network.weight + network.bias
    return np.log(np.maximum(softmax(scores), 1e-12))


def predict(texts: list[str | None], network: Network, tables) -> tuple[list[str], list[float]]:
    """Language and probability per text; a text without a letter, or null, is unknown with score 0."""
    known = [i for i, text in enumerate(texts) if text and LETTER.search(text)]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not known or not network.languages:
        return names, scores
    sums, weight = np.zeros((len(known), len(network.languages))), np.zeros(len(known))
    # Texts one after the other, TOGETHER windows at a time: memory does not follow the length of a text.
    data, owner, length = windows_of([texts[i] for i in known])
    for start in range(0, len(data), TOGETHER):
        part = slice(start, start + TOGETHER)
        np.add.at(sums, owner[part], log_probabilities(data[part], network, tables) * length[part, None])
        np.add.at(weight, owner[part], length[part])
    share = softmax(sums / weight[:, None])
    for i, row in zip(known, share):
        names[i], scores[i] = network.languages[int(row.argmax())], float(row.max())
    return names, scores


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Network:
    """Train on at most `per_language` labelled passages of each language, chosen by a hash of the key, held-out rows excluded.

    What is shuffled and what the driver receives is bounded: a few times per_language passages of PASSAGE characters for each of at
    most MOST_LANGUAGES languages, the frequent ones first.
    """
    rows = df.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if counts:
        # Of a frequent language only a share by hash, four times what is wanted, is ranked; a rare one is ranked whole.
        shares = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], min(1.0, 4 * per_language / row["count"]))])
        draw = F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col(text)), F.lit(1 << 30)) / (1 << 30)
        start = F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.greatest(F.length(text) - PASSAGE + 1, F.lit(1))) + 1
        rows = rows.where(draw <= F.element_at(shares, F.col(lang)))
        rows = rows.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.substring(F.col(text), start.cast("int"), F.lit(PASSAGE)).alias("passage"))
        ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "key"), "key", "passage")))
        sample = ranked.where(F.col("n") <= per_language).select("lang", "passage", "n").collect()
    else:
        sample = []
    sample = sorted((row["lang"], row["n"], row["passage"]) for row in sample)
    if not sample:
        return Network([], np.zeros((256, DIMENSIONS)), [np.zeros((w, DIMENSIONS, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), np.zeros((FILTERS * len(WIDTHS), 0)), np.zeros(0))
    return train([row[2] for row in sample], [row[0] for row in sample])


def identify(df: DataFrame, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Rows (*keep, lang, score), one per input row in full; only `text` is looked at. `lang` and `score` must be new names.

    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned. Repeated rows stay;
    other columns are not read, and columns of `keep` pass through whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            names, scores = predict(batch.column(0).to_pylist(), network, tables)
            yield batch_of((*keep, lang, score), (*batch.columns[1:], pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())))

    kinds = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep)
    # The text comes first, under a name that no kept column has.
    own = fresh("text", keep)
    return map_arrow(df.select(F.col(text).alias(own), *[F.col(f"`{name}`") for name in keep]), run, f"{kinds}, `{lang}` string, `{score}` double")
