"""Language identification by prediction by partial matching.

Method: for each language a variable-order byte context tree (contexts of 0 to
ORDER bytes) is counted over training texts and then frozen. A byte costs its code
length under PPM with escape method C and exclusions: in the longest context seen
in training, a seen byte costs log2((total + distinct) / count), otherwise an
escape is coded and the next shorter context is tried with the bytes already ruled
out excluded; below order 0 all bytes left are equally likely. A context never
seen costs no escape. Statistics don't change while scoring, so the whole tree is
flattened once into a table (context, byte) -> bits per language, and a text costs
the sum over its bytes: the exact code length. The prediction is the language of
the least code length; the score is its posterior under equal priors.

Bytes: A-Z count as a-z, a digit as 0, white space as one space. Bytes that no
training text has share one symbol.

Every language of the labelled rows is learned. Training is bounded per language:
at most `docs_per_lang` texts and about `bytes_per_lang` bytes, taken in the order
of a hash of the id; texts over `max_doc_bytes` bytes only where a language has no
shorter ones (of each the first `bytes_per_lang` bytes). Languages whose table would
exceed BLOCK_CELLS are held as several tables over the same symbols, with the same
code lengths; a worker unpacks one of them at a time. Prediction reads whole texts.

Defined results: `und` with score 0 for a null text, a text without a letter, or
when nothing could be learned; ties go to the first language in byte order. Repeated rows
get the same prediction each; of rows that share an id one text is learned from (the least).
Very long texts are scored whole. Input columns are kept; the operator's own columns
replace columns of the same name. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import cut, drop, few, kept_and

ORDER = 3
DOCS_PER_LANG = 400
BYTES_PER_LANG = 600_000
MAX_DOC_BYTES = 20_000
#: Cells (4 bytes each) of a table of several languages.
BLOCK_CELLS = 60_000_000
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass
class Model:
    """langs; symbol of each byte; the row of each context; bits[row * n_symbols + symbol, lang]."""

    langs: list[str]
    symbol: np.ndarray
    n_symbols: int
    context_row: np.ndarray
    bits: np.ndarray


def seen_bytes(samples: dict[str, list[bytes]]) -> np.ndarray:
    """Which bytes, after folding, the texts have."""
    seen = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            seen[_FOLD[np.frombuffer(t, np.uint8)]] = True
    return seen


def train_blocks(samples: dict[str, list[bytes]], block_cells: int = BLOCK_CELLS) -> list[Model]:
    """Models of the languages in blocks, in order of the languages; code lengths don't depend on the blocks."""
    langs = sorted(k for k, v in samples.items() if v)
    seen = seen_bytes(samples)
    a = int(seen.sum()) + 1
    blocks: list[list[str]] = []
    contexts = 0
    for lang in langs:
        # at most so many contexts: the distinct sequences of ORDER bytes
        own = 1 + len(np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(ORDER, 32, np.uint8), _FOLD[np.frombuffer(t, np.uint8)]]).astype(np.int64), ORDER) @ (256 ** np.arange(ORDER)) for t in samples[lang]])))
        contexts += own
        if not blocks or (a ** (ORDER - 1) + contexts) * a * (len(blocks[-1]) + 1) > block_cells:
            blocks.append([])
            contexts = own
        blocks[-1].append(lang)
    return [train({k: samples[k] for k in block}, seen) for block in blocks]


def train(samples: dict[str, list[bytes]], seen: np.ndarray | None = None) -> Model | None:
    """Count and freeze the context trees. samples: texts by language; seen: the bytes that count as seen (default: theirs)."""
    langs = sorted(k for k, v in samples.items() if v)
    if not langs:
        return None
    if seen is None:
        seen = seen_bytes({k: samples[k] for k in langs})
    symbol = np.zeros(256, np.int64)  # 0: the bytes not seen
    symbol[seen] = np.arange(1, int(seen.sum()) + 1)
    symbol = symbol[_FOLD]
    a = int(seen.sum()) + 1
    # counts[lang][order]: context number -> counts of the next symbol
    counts: dict[str, list[dict[int, np.ndarray]]] = {}
    for lang in langs:
        trees = []
        for order in range(ORDER + 1):
            keys = []
            for t in samples[lang]:
                s = symbol[np.frombuffer(t, np.uint8)]
                s = np.concatenate([np.full(ORDER, symbol[32]), s])
                key = s[ORDER:].copy()
                for back in range(1, order + 1):
                    key += s[ORDER - back : len(s) - back] * a**back
                keys.append(key)
            values, n = np.unique(np.concatenate(keys), return_counts=True)
            tree: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(a, np.int64))
            for v, c in zip(values.tolist(), n.tolist(), strict=True):
                tree[v // a][v % a] = c
            trees.append(dict(tree))
        counts[lang] = trees
    contexts = sorted({c for lang in langs for c in counts[lang][ORDER]})
    shorter = a ** (ORDER - 1)
    context_row = np.empty(a**ORDER, np.int32)
    context_row[:] = np.arange(a**ORDER) % shorter  # a context never seen stands for its suffix
    context_row[contexts] = shorter + np.arange(len(contexts))
    suffixes = sorted({s for lang in langs for s in counts[lang][ORDER - 1]})
    bits = np.empty(((shorter + len(contexts)), a, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        trees = counts[lang]

        def cost(tree: list, context: int, order: int) -> np.ndarray:
            out, left, so_far = np.zeros(a), np.ones(a, bool), 0.0
            for o in range(order, -1, -1):
                own = tree[o].get(context % a**o)
                if own is None:
                    continue
                own = np.where(left, own, 0)
                hit = own > 0
                if not hit.any():
                    continue
                total, distinct = own.sum(), hit.sum()
                out[hit] = so_far + np.log2((total + distinct) / own[hit])
                left &= ~hit
                so_far += np.log2((total + distinct) / distinct)
            out[left] = so_far + np.log2(max(1, left.sum()))
            return out

        by_one = [cost(trees, c, 1) for c in range(a)]  # what a suffix never seen falls back to
        for c in range(shorter):
            bits[c, :, k] = by_one[c % a]
        for c in suffixes:
            bits[c, :, k] = cost(trees, c, ORDER - 1)
        for row, c in enumerate(contexts):
            bits[shorter + row, :, k] = cost(trees, c, ORDER) if c in trees[ORDER] else bits[c % shorter, :, k]
    return Model(langs, symbol, a, context_row, bits.reshape(-1, len(langs)))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text (row) under each language (column). Texts start after a space."""
    n, a = len(offsets) - 1, model.n_symbols
    out = np.zeros((n, len(model.langs)))
    if not len(data):
        return out
    s = model.symbol[data]
    key = np.zeros(len(data), np.int64)
    space = model.symbol[32]
    begins = np.unique(offsets[:-1][offsets[:-1] < len(data)])
    prev = s
    for back in range(1, ORDER + 1):
        prev = np.concatenate([[space], prev[:-1]])
        at = begins + back - 1  # the first bytes of a text see spaces, not the text before
        for b in range(back):
            near = begins + b
            prev[near[near < len(data)]] = space
        del at
        key += prev * a ** (back - 1)
    cell = model.context_row[key].astype(np.int64) * a + s
    full = np.flatnonzero(np.diff(offsets) > 0)
    out[full] = np.add.reduceat(model.bits[cell].astype(np.float64), offsets[full], axis=0)
    return out


def sample(docs: DataFrame, lang: Column, usable: Column, id_col: str, text_col: str, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG, max_doc_bytes: int = MAX_DOC_BYTES) -> dict[str, list[bytes]]:
    """The training sample of every language, bounded per language, on the driver.

    Distinct ids are counted per language (by a sketch, with a deviation of five percent); then only
    those pass whose hash is so low that about half as many again as docs_per_lang are left of each language,
    whatever rows share an id. These few are ranked, one row of each id, and one text of each chosen id is read.
    """
    size = F.octet_length(text_col)
    labelled = docs.where(usable & lang.isNotNull() & (size > 0))
    rows = labelled.select(lang.alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h"), size.alias("n"), (size > max_doc_bytes).alias("long"))
    counts = cut(rows.groupBy("lang", "long").agg(F.approx_count_distinct("id", 0.05).alias("c")))
    share = (F.pmod("h", F.lit(1 << 30)) + 1) / (1 << 30)
    rows = rows.join(few(counts), ["lang", "long"]).where(share <= (1.5 * docs_per_lang + 50) / F.col("c")).groupBy("lang", "long", "id", "h").agg(F.min("n").alias("n"))
    order = Window.partitionBy("lang").orderBy("long", F.pmod("h", F.lit(1 << 30)), "id")  # long texts only after all others
    chosen = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang)
    before = F.sum(F.least("n", F.lit(bytes_per_lang))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.select("id", "lang", "long", F.first("long").over(order).alias("first"), F.coalesce(before, F.lit(0)).alias("before"))
    # stays in Spark: rows made from a Python list start Python workers of another kind in every executor, beside those that predict
    wanted = cut(chosen.where((F.col("long") == F.col("first")) & (F.col("before") < bytes_per_lang)).select("id", "lang", "long"))
    texts = labelled.select(F.col(id_col).alias("id"), F.left(text_col, F.lit(bytes_per_lang)).alias("t"), lang.alias("lang"), (size > max_doc_bytes).alias("long"))
    got = texts.join(F.broadcast(wanted), ["id", "lang", "long"], "left_semi").groupBy("id", "lang", "long").agg(F.min("t").alias("t"))  # one text of each id
    out: dict[str, list[bytes]] = {}
    for r in sorted(got.collect(), key=lambda r: (r["id"], r["lang"], r["t"])):
        out.setdefault(r["lang"], []).append(r["t"].encode()[:bytes_per_lang])
    drop(wanted)
    return out


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its posterior; whole texts, no shuffle. models: blocks of languages in order."""
    own = (lang_col, score_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    several = len(models) > 1
    shared = [docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(m), 1) if several else m) for m in models]
    frame = kept_and(docs, kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = textkit.utf8(batch.column(len(kept)))
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            data, offsets = textkit.buffers(text)
            n = len(text)
            langs, least, total = np.full(n, UNDETERMINED, object), np.full(n, np.inf), np.zeros(n)
            for block in shared:
                m = pickle.loads(zlib.decompress(block.value)) if several else block.value
                names = np.array(m.langs, object)
                for lo, hi in textkit.pieces(text):
                    bits = code_lengths(m, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    best = bits.argmin(axis=1)
                    now = bits[np.arange(hi - lo), best]
                    better, before = now < least[lo:hi], least[lo:hi].copy()
                    low = np.where(better, now, before)
                    total[lo:hi] = total[lo:hi] * np.exp2(np.maximum(low - before, -1000)) + np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                    least[lo:hi] = low
                    langs[lo:hi] = np.where(better, names[best], langs[lo:hi])
                del m
            ok = letters.astype(bool) if len(shared) else np.zeros(n, bool)
            scores = np.where(ok, 1 / np.where(total > 0, total, 1), 0.0)
            langs = np.where(ok, langs, UNDETERMINED)
            for lo, hi in textkit.pieces(text):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + [pa.array(langs[lo:hi], pa.string()), pa.array(scores[lo:hi], pa.float64())], names=[*kept, lang_col, score_col])

    return frame.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The test fold: a fifth of the ids, by the CRC-32 of their decimal text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_on: Column | None = None) -> list[Model]:
    """Models of the labelled rows that train_on selects (default: not held out); none where no row has a language."""
    usable = F.coalesce(~held_out(id_col) if train_on is None else train_on, F.lit(False))
    return train_blocks(sample(docs, F.col(lang_col), usable, id_col, text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_on: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows that train_on selects (default: not held out), then predict every row."""
    return predict(docs, learn(docs, id_col, text_col, lang_col, train_on), text_col, keep=keep)
