"""Line dedup: a deletion-neighbourhood join over lines, by words, and by letters where there are few words.

Two lines match when one word inserted, deleted or replaced turns one into the other. Each
line emits itself and every variant with one word left out as hashed keys; lines that meet
in a key are within the bound (the same gap: a replaced word; a whole line and a variant: an
inserted one), the edit distance is verified on the words, and the earliest line is kept.
Lines of fewer words than that bound needs are sequences of letters instead, and match across
one edited letter; all else is the same. Equal lines of any length are duplicates.

Equal lines are one line from the start. Only lines that share their first or their last
half with another line emit variants: an edit of one word leaves one half as it was, so no
match is lost. Within a key only the earliest line is joined on, so a large group of similar
lines costs a key per line and not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import ROWS, Blocks, even_keys, rows, runs, signed

#: From this number of words on lines match across one edited word; shorter lines of as many letters across one edited letter.
NEAR_WORDS = 10

VARIANT = np.dtype([("h", "<u8"), ("pos", "<i4"), ("doc", "<i8"), ("line", "<i4"), ("th", "<i8"), ("lh", "<u8")])
#: Stands for a null doc_id, which is the earliest.
NULL_DOC = -(2**63)
LETTER = np.uint64(0xA0761D6478BD642F)
STEP, BACK, GAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all lines, each line's offset, and each text's offset among the lines."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    codes, offsets, dictionary = common.words_of(lists.flatten(), lower=False)
    return common.word_hashes(dictionary)[codes], offsets, lists.offsets.to_numpy() - lists.offsets[0].as_py()


def line_letters(texts: pa.Array, words: np.ndarray, offsets: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines of `near` words and more, of the letters (one space between words) of others, and each line's offset."""
    n = np.diff(offsets)
    short = n < near
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n").flatten().filter(pa.array(short)).cast(pa.binary())
    codes = np.frombuffer(b"".join(b" ".join(x.split()) + b"\n" for x in lines.to_pylist()).decode().encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    sizes = n.copy()
    sizes[short] = np.diff(ends, prepend=-1) - 1
    out, by_letter = np.empty(int(sizes.sum()), np.uint64), np.repeat(short, sizes)
    out[by_letter] = common.mix(codes[codes != 10].astype(np.uint64) + LETTER)
    out[~by_letter] = words[np.repeat(~short, n)]
    return out, np.concatenate([[0], np.cumsum(sizes)])


def sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def line_keys(words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: number of its words (or letters), hash, and four keys of its halves (0: none), where it has at least `least`."""
    n = np.diff(offsets)
    start = np.repeat(offsets[:-1], n)
    at = (np.arange(len(words)) - start).astype(np.uint64)
    back = np.repeat(n, n).astype(np.uint64) - np.uint64(1) - at
    forward, reverse = sums(common.mix(words + at * STEP)), sums(common.mix(words + back * BACK))
    a, b = offsets[:-1], offsets[1:]
    own = common.mix(forward[b] - forward[a] + n.astype(np.uint64))
    keys = np.zeros((len(n), 4), np.uint64)
    near = n >= least
    for k, half in enumerate((np.maximum(n - 1, 0) // 2, np.maximum(n - 2, 0) // 2)):
        keys[:, k] = np.where(near & ((k == 0) | (half != np.maximum(n - 1, 0) // 2)), common.mix(forward[a + half] - forward[a] + half.astype(np.uint64)), 0)
        keys[:, 2 + k] = np.where(near & ((k == 0) | (half != np.maximum(n - 1, 0) // 2)), common.mix(reverse[b] - reverse[b - half] + half.astype(np.uint64) + GAP), 0)
    return n, own, keys


def lines_of(docs: DataFrame, near: int) -> DataFrame:
    """(doc_id, th, line, lh, keys) of every line that may be removed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(it, "text"):
            words, offsets, texts = line_words(batch.column("text"))
            n, own, _ = line_keys(words, offsets, near)
            keys = line_keys(*line_letters(batch.column("text"), words, offsets, near), near)[2]
            doc = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
            line = np.arange(len(n)) - texts[doc]
            keep = np.flatnonzero(n > 0)
            used = keys[keep] != 0
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)), pa.array(signed(keys[keep][used])))
            take = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(line[keep].astype(np.int32)), pa.array(signed(own[keep])), values], ["doc_id", "th", "line", "lh", "keys"])

    return docs.mapInArrow(common.lean(run), "doc_id long, th long, line int, lh long, keys array<long>")


def words_at(docs: DataFrame, near: int) -> DataFrame:
    """(lh, doc, th, line, w) of the lines whose numbers stand in `at`: their word (or letter) hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(it, "text"):
            words, offsets, texts = line_words(batch.column("text"))
            _, own, _ = line_keys(words, offsets, near)
            words, offsets = line_letters(batch.column("text"), words, offsets, near)
            n = np.diff(offsets)
            at = batch.column("at")
            pick = at.flatten().to_numpy() + np.repeat(texts[:-1], np.diff(at.offsets.to_numpy()))
            doc = np.repeat(np.arange(len(texts) - 1), np.diff(at.offsets.to_numpy()))
            sizes = n[pick]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(offsets[pick] - ends[:-1], sizes) + np.arange(ends[-1])
            w = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(words[flat])))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(signed(own[pick])), pc.fill_null(batch.column("doc_id"), NULL_DOC).take(take), batch.column("th").take(take), at.flatten(), w], ["lh", "doc", "th", "line", "w"])

    return docs.mapInArrow(common.lean(run), "lh long, doc long, th long, line int, w array<long>")


def variants(lh: np.ndarray, doc: np.ndarray, th: np.ndarray, line: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every line itself (pos -1) and with each of its words left out (pos: which)."""
    n = np.diff(offsets)
    start = np.repeat(offsets[:-1], n)
    at = np.arange(len(words)) - start
    here, before = sums(common.mix(words + at.astype(np.uint64) * STEP)), sums(common.mix(words + (at.astype(np.uint64) - np.uint64(1)) * STEP))
    a, b = offsets[:-1], offsets[1:]
    out = np.empty(len(n) + len(words), VARIANT)
    of = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n)])
    end = np.repeat(b, n)
    gap = here[np.arange(len(words))] - here[start] + before[end] - before[np.arange(len(words)) + 1]
    size = np.concatenate([n, np.repeat(n - 1, n)]).astype(np.uint64)
    out["h"] = common.mix(np.concatenate([here[b] - here[a], gap]) + size)
    out["pos"] = np.concatenate([np.full(len(n), -1), at])
    for name, x in (("doc", doc), ("line", line), ("th", th), ("lh", lh)):
        out[name] = x[of]
    return out


def earliest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v sorted by key, gap and age, and where each (key, gap) begins."""
    v = v[np.lexsort((v["lh"], v["th"], v["line"], v["doc"], v["pos"], v["h"]))]
    new = np.ones(len(v), bool)
    new[1:] = (v["h"][1:] != v["h"][:-1]) | (v["pos"][1:] != v["pos"][:-1])
    return v, np.flatnonzero(new)


def neighbours(known: DataFrame, keys: list[int]) -> DataFrame:
    """(a, b): line a has an earlier line b in one of its keys; for each key the earliest."""

    def told(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return rows(len(a), key=[keys[i % len(keys)] for i in range(len(a))], a=signed(a), b=signed(b))

    def within(v: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        first = np.zeros(len(v), bool)
        first[firsts] = True
        lead = np.repeat(firsts, np.diff(np.concatenate([firsts, [len(v)]])))
        return told(v["lh"][~first].copy(), v["lh"][lead[~first]].copy())

    def mapper(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(keys, VARIANT)

        def flush() -> Iterator[pa.RecordBatch]:
            v, firsts = earliest(blocks.take())
            yield within(v, firsts)  # a line with an earlier one in the same gap needs no other
            yield from blocks.send(v[firsts])

        for batch in it:
            w = batch.column("w")
            offsets = w.offsets.to_numpy()
            words = w.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            column = lambda name: batch.column(name).to_numpy()  # noqa: B023, E731
            if blocks.add(variants(column("lh").view(np.uint64), column("doc"), column("th"), column("line"), words, offsets - offsets[0])):
                yield from flush()
        yield from flush()

    def reducer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in it:
            is_block = batch.column("block").is_valid()
            held += [np.frombuffer(x, VARIANT) for x in batch.column("block").filter(is_block).to_pylist()]
            yield batch.filter(pc.invert(is_block))
        v, firsts = earliest(np.concatenate(held) if held else np.empty(0, VARIANT))
        yield within(v, firsts)
        v = v[firsts]
        starts, lengths = runs(v["h"])
        whole = v["pos"][starts] == -1 if len(starts) else np.empty(0, bool)
        for s, m in zip(starts[whole & (lengths > 1)].tolist(), lengths[whole & (lengths > 1)].tolist(), strict=True):
            own, others = v[s], v[s + 1 : s + m]
            age = lambda x: (int(x["doc"]), int(x["line"]), int(x["th"]), int(x["lh"]))
            later = np.array([age(x) > age(own) for x in others])
            yield told(others["lh"][later].copy(), np.full(int(later.sum()), own["lh"]))
            best = min(others, key=age)
            if age(best) < age(own):
                yield told(own["lh"].reshape(1).copy(), best["lh"].reshape(1).copy())

    met = known.mapInArrow(common.lean(mapper), ROWS).repartition(len(keys), "key").mapInArrow(common.lean(reducer), ROWS)
    return met.where("a <> b").select("a", "b").distinct()


def one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether at most one word inserted, deleted or replaced turns x into y."""
    if abs(len(x) - len(y)) > 1:
        return False
    k = min(len(x), len(y))
    same = x[:k] == y[:k]
    first = k if same.all() else int(np.argmin(same))
    tail = min(k - first, len(x) - first, len(y) - first)
    equal = x[len(x) - tail :] == y[len(y) - tail :] if tail else np.ones(0, bool)
    last = tail if equal.all() else int(np.argmin(equal[::-1]))
    return max(len(x), len(y)) - first - last <= 1


def checked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Lines (lh) of which at least one pair is within the edit bound."""
    x, y = known.select(F.col("lh").alias("a"), F.col("w").alias("w1")), known.select(F.col("lh").alias("b"), F.col("w").alias("w2"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            left, right = batch.column("w1"), batch.column("w2")
            keep = pa.array([one_edit(p.values.to_numpy(), q.values.to_numpy()) for p, q in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep)], ["lh"])

    return pairs.join(x, "a").join(y, "b").select("a", "w1", "w2").mapInArrow(common.lean(run), "lh long").distinct()


def dedup(docs: DataFrame, near: int = NEAR_WORDS) -> DataFrame:
    """docs with every line removed that an earlier line matches; adds n_lines and n_removed.

    Lines end with a line feed; one without words stays. A line is removed where an equal one (white space
    between words apart) stands earlier, or where its first occurrence has an earlier line within one edited
    word, for lines of at least `near` words, or within one edited letter, for shorter lines of as many
    letters (one space between words). Earlier: smaller doc_id (null first), then smaller line number. Rows
    that are equal in doc_id and text are one document and keep the same lines. All rows stay, and all
    columns; a text of which nothing stays is empty, a null text stays null; a long text counts whole; an
    empty table stays empty. Only `text` changes.
    """
    spark = docs.sparkSession
    keys = even_keys(spark, common.partitions(spark, docs))
    text = F.col("text").cast("string")
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), text.alias("text"))
    first = lines_of(slim, near).groupBy("lh").agg(F.min(F.struct("doc_id", "line", "th")).alias("f"), F.first("keys").alias("keys"))
    first = common.materialize(first.select("lh", "f.*", "keys"), "lines")
    halves = first.select("lh", F.explode("keys").alias("k"))
    shared = halves.groupBy("k").agg(F.min("lh").alias("x"), F.max("lh").alias("y")).where("x <> y").select("k")
    alike = halves.join(shared, "k", "left_semi").select("lh").distinct()
    at = first.join(alike, "lh", "left_semi").groupBy("doc_id", "th").agg(F.collect_list("line").alias("at"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["th"] == y["th"])
    unique = slim.join(at, same(slim, at)).select(slim["doc_id"], slim["th"], "text", "at").dropDuplicates(["doc_id", "th"])
    known = common.materialize(words_at(unique, near), "words")
    gone = common.materialize(checked(neighbours(known, keys), known), "gone")
    kept = first.join(gone, "lh", "left_anti").groupBy(F.col("doc_id").alias("_kept_doc"), F.col("th").alias("_kept_th")).agg(F.collect_list("line").alias("_kept"))
    own = [f"_own{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)], F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"), th.alias("_th"))
    joined = named.join(kept, named["_doc"].eqNullSafe(kept["_kept_doc"]) & (named["_th"] == kept["_kept_th"]), "left").select(*own, "_text", "_kept")
    place = docs.columns.index("text")
    schema = [f for f in docs.schema.fields]

    def rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, lines_, gone_ = [], [], []
            for text_, kept_ in zip(batch.column("_text").to_pylist(), batch.column("_kept").to_pylist(), strict=True):
                lines = [] if text_ is None else text_.encode().split(b"\n")
                stay = set(kept_ or ())
                new = [x for i, x in enumerate(lines) if i in stay or not x.split(None, 1)]
                lines_.append(len(lines))
                gone_.append(len(lines) - len(new))
                out.append(None if text_ is None else text_ if len(new) == len(lines) else b"\n".join(new).decode())
            arrays = [pa.array(out, pa.string()) if i == place else batch.column(i) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines_, pa.int64()), pa.array(gone_, pa.int64())], [*own, "_n", "_gone"])

    types = ", ".join(f"{o} {'string' if i == place else f.dataType.simpleString()}" for i, (o, f) in enumerate(zip(own, schema, strict=True)))
    made = joined.mapInArrow(common.lean(rebuild), f"{types}, _n long, _gone long")
    return made.toDF(*docs.columns, *(c if c not in docs.columns else f"dedup_{c}" for c in ("n_lines", "n_removed")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs after dedup of every line, without rows that had lines removed and have no words left; the columns of docs, whatever their names.

    A column n_chars gets the length of the new text.
    """
    own = [f"_own{i}" for i in range(len(docs.columns))]
    made = dedup(docs).toDF(*own, "_n", "_gone")
    text = F.col(own[docs.columns.index("text")])
    made = made.where((F.col("_gone") == 0) | text.rlike("[^\\x20\\x09-\\x0D]"))
    columns = [F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(o) for c, o in zip(docs.columns, own, strict=True)]
    return made.select(*[x.alias(f"_new{i}") for i, x in enumerate(columns)]).toDF(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP9 = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
), w AS (SELECT doc_id, i, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM l),
f AS (SELECT w, min((doc_id, i)) AS f FROM w WHERE len(w) > 0 GROUP BY w),
n AS (SELECT * FROM (SELECT w, f, len(w) >= 10 AS b, CASE WHEN len(w) >= 10 THEN w ELSE regexp_extract_all(array_to_string(w, ' '), '(?s).') END AS u FROM f) WHERE len(u) >= 10),
v AS (
  SELECT w, f, b, 0 AS p, u AS v FROM n
  UNION ALL
  SELECT w, f, b, p, list_concat(u[:p - 1], u[p + 1:]) FROM (SELECT *, unnest(range(1, len(u) + 1)) AS p FROM n)
), gone AS (
  SELECT DISTINCT x.w FROM v x JOIN v y ON x.v = y.v AND x.b = y.b AND y.f < x.f AND (x.p = y.p OR x.p = 0 OR y.p = 0)
), kept AS (SELECT f FROM f ANTI JOIN gone ON f.w = gone.w),
k AS (SELECT w.doc_id, w.i, w.line, len(w.w) = 0 OR kept.f IS NOT NULL AS stays FROM w LEFT JOIN kept ON kept.f = (w.doc_id, w.i))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') END AS text,
  count(k.i) AS n_lines, count(k.i) FILTER (WHERE NOT stays) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""
