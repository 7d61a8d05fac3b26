"""Phrase mining by pivot partitioning: each frequent phrase is counted where its rarest word is.

Texts are coded in slabs, with a vocabulary each; word counts come from the vocabularies, and each
slab gets the counts of its own words back by a join. For every occurrence of a word (the pivot)
the slab then emits the fragment around it, rewritten: rarer and infrequent words are cut off, and
what is left is at most three words on either side. Fragments are routed to their pivot, equal
ones of a slab with a count. There the phrases that hold the pivot, and so no rarer word, are
counted: every phrase at one pivot only. A pivot with very many occurrences is dealt to several
parts, whose counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import bytes_of, discard, release, stored
from provenia.llm.words import mixed

#: Words of the longest phrase; occurrences that a phrase needs; phrases reported for a language; share of a phrase's
#: occurrences within a longer one above which it is dropped, in percent; factor of the score.
LONGEST, LEAST, TOP, WITHIN, SCALE = 4, 30, 2000, 80, 2_000_000
#: Bytes of text of a slab, about (a text is never cut); fragments counted together, about; occurrences above which a pivot is split.
SLAB, MINED, SPLIT = 1 << 23, 1 << 18, 1 << 18
NO_LANGUAGE = "und"
_BREAK = 0xFF  # never a byte of UTF-8
_TABLE = bytes(_BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WIDE = 2 * (LONGEST - 1)
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_GRAM = f"lang string, {', '.join(f'{w} long' for w in WORDS)}, a long"


class _Vocabulary(dict):
    """Numbers of words from 1 on; 0 is a break between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with ``\\xff`` at the ends of its pieces."""
    return raw.translate(_TABLE).replace(b"\xff", b" \xff ").split()


def coded_slabs(docs: DataFrame) -> DataFrame:
    """Texts as word numbers: ``slab, lang, n_words, codes, words, counts``; a slab has texts of one language."""

    def row(at: int, lang: str, vocabulary: _Vocabulary, parts: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(parts)
        counts = np.bincount(codes, minlength=len(vocabulary))[1:]
        words = pa.array(list(vocabulary)[1:], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | at], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
                pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())),
            ],
            ["slab", "lang", "n_words", "codes", "words", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Vocabulary, list[np.ndarray], list[int]]] = {}
        made, end = 0, np.zeros(1, np.int32)
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True):
                words = tokens(raw or b"")
                if not words:
                    continue
                vocabulary, parts, size = held.setdefault(lang, (_Vocabulary({b"\xff": 0}), [], [0]))
                parts += [np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), end]
                size[0] += len(raw)
                if size[0] > SLAB or sum(s[0] for _, _, s in held.values()) > 2 * SLAB:
                    full = max(held, key=lambda k: held[k][2][0])
                    yield row(made, full, *held.pop(full)[:2])
                    made += 1
        for lang, (vocabulary, parts, _) in held.items():
            yield row(made, lang, vocabulary, parts)
            made += 1

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return rows.mapInArrow(run, "slab long, lang string, n_words long, codes binary, words array<string>, counts array<long>")


def fragments_of(codes: np.ndarray, code: np.ndarray, f: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments around every pivot of a slab, equal ones once: index of the pivot among the frequent words, how many words stand left and right, count, and the words' ids in order.

    ``code, f, ids`` are the frequent words of the slab. A word is rarer than another if it occurs
    less, or as often with a larger id: the same order in every slab. A pivot that stands left in
    its own fragment is cut off, so that a phrase with two of them is counted at the first.
    """
    by_rank = np.lexsort((ids, -f))
    blank = np.int32(len(by_rank))
    rank = np.full(int(max(codes.max(initial=0), code.max(initial=0))) + 1, blank, np.int32)
    rank[code[by_rank]] = np.arange(len(by_rank), dtype=np.int32)
    reach = LONGEST - 1
    x = np.concatenate([np.full(reach, blank, np.int32), rank[codes], np.full(reach, blank, np.int32)])
    n = len(codes)
    pivot = x[reach : reach + n]
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    on = pivot < blank
    for d in range(1, reach + 1):
        on = on & (x[reach - d : reach - d + n] < pivot)
        left += on
    on = pivot < blank
    for d in range(1, reach + 1):
        on = on & (x[reach + d : reach + d + n] <= pivot)
        right += on
    at = np.flatnonzero((left > 0) | (right > 0))
    pivot, left, right = pivot[at], left[at], right[at]
    around = np.empty((len(at), _WIDE), np.int32)
    h = np.zeros(len(at), np.uint64)
    for k, d in enumerate([*range(-reach, 0), *range(1, reach + 1)]):
        word = x[at + (reach + d)]
        word[(left < -d) if d < 0 else (right < d)] = -1
        around[:, k] = word
        h = mixed((h ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort((pivot.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    pivot, left, right, around = pivot[order], left[order], right[order], around[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (pivot[1:] != pivot[:-1]) | (around[1:] != around[:-1]).any(1)
    starts = np.flatnonzero(new)
    around = around[starts]
    count = np.diff(np.r_[starts, len(order)]).astype(np.uint32)
    return by_rank[pivot[starts]], (left[starts] | right[starts] << 2).astype(np.uint8), count, ids[by_rank][around[around >= 0]]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def route_fragments(slabs: DataFrame) -> DataFrame:
    """Fragments of slabs (``slab, lang, codes, known``), a row for each pivot of a slab: ``lang, pivot, part, whole, shapes, counts, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known")
            for i in range(batch.num_rows):
                own = known[i].values
                code, f, ids = (own.field(k).to_numpy(zero_copy_only=False) for k in ("code", "f", "id"))
                slab, lang = batch.column("slab")[i].as_py(), batch.column("lang")[i].as_py()
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32)
                word, shape, count, around = fragments_of(codes, code, f, ids)
                if not len(word):
                    continue
                cuts = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True])
                heads = word[cuts[:-1]]
                ends = np.r_[0, np.cumsum((shape & 3) + (shape >> 2), dtype=np.int64)][cuts]
                parts = -(-f[heads] // SPLIT)
                part = (mixed(np.full(len(heads), slab, np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(heads)), pa.array(ids[heads]), pa.array(part), pa.array(parts == 1),
                        _binary(cuts, shape), _binary(4 * cuts, count.view(np.uint8)), _binary(8 * ends, around.astype(np.int64).view(np.uint8)),
                    ],
                    ["lang", "pivot", "part", "whole", "shapes", "counts", "ids"],
                )

    return slabs.select("slab", "lang", "codes", "known").mapInArrow(
        run, "lang string, pivot long, part int, whole boolean, shapes binary, counts binary, ids binary"
    )


def count_phrases(owner: np.ndarray, pivots: np.ndarray, shape: np.ndarray, count: np.ndarray, around: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of some fragments that hold their pivots: for each length the words' ids, the counts, and the row a phrase comes from.

    ``owner`` is the row of each fragment, ``pivots`` the pivot of each row; what a fragment holds
    is as :func:`fragments_of` gives it.
    """
    reach = LONGEST - 1
    left, right = (shape & 3).astype(np.int64), (shape >> 2).astype(np.int64)
    ids, coded = np.unique(np.concatenate([around, pivots]), return_inverse=True)
    grid = np.full((len(shape), LONGEST + reach), -1, np.int64)
    column = np.arange(-reach, reach + 1)
    held = (column >= -left[:, None]) & (column <= right[:, None])
    held[:, reach] = False
    grid[held] = coded[: len(around)]
    grid[:, reach] = coded[len(around) :][owner]
    for m in range(2, LONGEST + 1):
        picked, whole = [], []
        for s in range(m):
            fits = np.flatnonzero((left >= s) & (right >= m - 1 - s))
            picked.append(grid[fits, reach - s : reach - s + m] if len(fits) else np.zeros((0, m), np.int64))
            whole.append(fits)
        words, at = np.concatenate(picked), np.concatenate(whole)
        if not len(at):
            continue
        key, size = words[:, 0], len(ids)
        for k in range(1, m):
            if size > (1 << 62) // len(ids):
                distinct, key = np.unique(key, return_inverse=True)
                size = len(distinct)
            key, size = key * len(ids) + words[:, k], size * len(ids)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = order[starts]
        yield ids[words[first]], np.add.reduceat(count[at[order]].astype(np.int64), starts), owner[at[first]]


def mine_fragments(routed: DataFrame, least: int) -> DataFrame:
    """Counts of the phrases at their pivots: ``lang, w1..w4, a`` (-1 after the last word).

    Rows come sorted by pivot; whole pivots are counted together, about ``MINED`` fragments at a
    time. Phrases of a whole pivot that occur less than ``least`` times stay; a split pivot's go on as they are.
    """

    def mined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        shapes = [np.frombuffer(b, np.uint8) for b in rows["shapes"].to_pylist()]
        owner = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
        flat = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
        whole = rows["whole"].to_numpy()
        for words, count, row in count_phrases(owner, rows["pivot"].to_numpy(), np.concatenate(shapes), flat("counts", np.uint32), flat("ids", np.int64)):
            keep = np.flatnonzero((count >= least) | ~whole[row])
            if len(keep):
                padded = np.full((len(keep), LONGEST), -1, np.int64)
                padded[:, : words.shape[1]] = words[keep]
                langs = rows["lang"].combine_chunks().take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([langs, *[pa.array(padded[:, k]) for k in range(LONGEST)], pa.array(count[keep])], ["lang", *WORDS, "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, whole = batch.column("pivot").to_numpy(), batch.column("whole").to_numpy(zero_copy_only=False)
            each = np.diff(np.frombuffer(batch.column("shapes").buffers()[1], np.int32)[batch.column("shapes").offset :][: batch.num_rows + 1])
            last = held[-1].column("pivot")[-1].as_py() if held else None
            # Between two rows of a split pivot a cut does no harm: its counts are added up later.
            free = np.r_[last is not None and (last != pivot[0] or not whole[0]), (pivot[1:] != pivot[:-1]) | ~whole[1:]]
            since = 0
            for i in range(batch.num_rows):
                if size >= MINED and free[i]:
                    held.append(batch.slice(since, i - since))
                    yield from mined(pa.Table.from_batches([h for h in held if h.num_rows]))
                    held, size, since = [], 0, i
                size += int(each[i])
            held.append(batch.slice(since))
        if held:
            yield from mined(pa.Table.from_batches(held))

    return routed.mapInArrow(run, _GRAM)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: words ``lang, word, f, id``, phrases ``lang, w1..w4, a`` of ids with at least ``least`` occurrences, and ``lang, n``."""
    spark = docs.sparkSession
    slabs = stored(coded_slabs(docs), "slabs")
    totals = stored(slabs.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = slabs.select("slab", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    listed = listed.select("slab", "lang", (F.col("at") + 1).cast("int").alias("code"), F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    frequent = listed.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    words = stored(frequent.withColumn("id", F.monotonically_increasing_id()), "words")
    known = listed.join(words, ["lang", "word"]).groupBy("slab").agg(F.collect_list(F.struct("code", "f", "id")).alias("known"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), every // (4 * MINED))
    routed = route_fragments(slabs.join(known, "slab")).repartition(parts, "pivot", "part").sortWithinPartitions("pivot", "part")
    counted = mine_fragments(routed, least).groupBy("lang", *WORDS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    grams = stored(counted, "phrases")
    discard(slabs)
    release(spark)
    return words, grams, totals


def _padded(words: list[Column]) -> Column:
    """Words of a part of a phrase, as a struct that can be joined on."""
    return F.struct(*[(words[k] if k < len(words) else F.lit(-1).cast("long")).alias(w) for k, w in enumerate(WORDS)])


def _whole(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The phrases of each language that hold together best: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is two to four words within a piece of a text (between ``.,;:!?`` and line ends), A-Z
    lower-cased, that occurs at least ``least`` times (``a``). It is cut where its score
    ``SCALE * a // (l + r)`` is lowest, ``l`` and ``r`` being the counts of both sides; of equal
    cuts the first counts. A phrase is dropped if a longer one that holds it has at least
    ``WITHIN`` percent of its occurrences. ``n`` is the number of all words of the language. The
    first ``top`` by score, ``a`` and phrase are returned.

    Null texts count as empty, a null language as ``und``; documents count one by one, repeated
    or without an id; extra columns are left aside. No texts, no rows. Counts are exact.
    """
    words, grams, totals = frequent_phrases(docs, least)
    col = [F.col(w) for w in WORDS]
    length = sum((c >= 0).cast("int") for c in col)
    grams = grams.withColumn("m", length)
    counts = grams.select(_padded(col).alias("part"), F.col("a").alias("count"))
    counts = counts.unionByName(words.select(_padded([F.col("id")]).alias("part"), F.col("f").alias("count")))
    blank = F.lit(-1).cast("long")
    cuts = []
    for m in range(2, LONGEST + 1):
        here = [F.struct(F.lit(k).alias("k"), _padded(col[:k]).alias("first"), _padded(col[k:m]).alias("rest")) for k in range(1, m)]
        cuts.append((m, F.array(*here)))
    at = F.when(F.col("m") == cuts[0][0], cuts[0][1])
    for m, c in cuts[1:]:
        at = at.when(F.col("m") == m, c)
    cut = grams.select("lang", *WORDS, "a", F.explode(at).alias("cut")).select("lang", *WORDS, "a", "cut.*")
    cut = cut.join(counts.select(F.col("part").alias("first"), F.col("count").alias("l")), "first")
    cut = cut.join(counts.select(F.col("part").alias("rest"), F.col("count").alias("r")), "rest")
    cut = cut.withColumn("score", F.expr(f"cast(a as decimal(20,0)) * cast({SCALE} as decimal(8,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = cut.groupBy("lang", *WORDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", *WORDS, "a", "low.score", "low.l", "low.r")

    inner = []
    for m in range(3, LONGEST + 1):
        parts = [_padded(col[s : s + k]) for k in range(2, m) for s in range(m - k + 1)]
        inner.append(grams.where(F.col("m") == m).select(F.explode(F.array(*parts)).alias("part"), F.col("a").alias("longer")))
    held = inner[0]
    for other in inner[1:]:
        held = held.unionByName(other)
    held = held.groupBy("part").agg(F.max("longer").alias("longer")).select("part.*", "longer")
    kept = lowest.join(held, WORDS, "left").where(F.col("longer").isNull() | (100 * _whole(F.col("longer")) < WITHIN * _whole(F.col("a"))))

    # First cut by rank without the phrases' texts, which only break ties; then read the words of what is left.
    by = Window.partitionBy("lang")
    best = kept.withColumn("near", F.rank().over(by.orderBy(F.desc("score"), F.desc("a")))).where(F.col("near") <= top).drop("near", "longer")
    for w in WORDS:
        best = best.join(words.select(F.col("id").alias(w), F.col("word").alias(f"{w}_text")), w, "left" if w > "w2" else "inner")
    phrase = F.concat_ws(" ", *[f"{w}_text" for w in WORDS])
    best = best.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").join(totals, "lang")
    rank = F.row_number().over(by.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _grams_sql() -> str:
    return " union all ".join(f"select lang, array_to_string(ws[i:i+{m - 1}], ' ') phrase, {m} m from (select lang, ws, unnest(range(1, len(ws) - {m - 2})) i from pieces)" for m in range(1, LONGEST + 1))


SQL = f"""
with texts as (select coalesce(lang, '{NO_LANGUAGE}') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as materialized (select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') ws from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) p from texts)),
totals as (select lang, sum(len(ws))::bigint n from pieces group by lang),
grams as materialized (select lang, phrase, m, count(*)::hugeint a from ({_grams_sql()}) group by all having count(*) >= {LEAST}),
cuts as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') p, array_to_string(ws[k+1:], ' ') q from (select *, string_split(phrase, ' ') ws, unnest(range(1, m)) k from grams where m > 1)),
scored as (select c.lang, c.phrase, c.a, k, l.a l, r.a r, ({SCALE} * c.a) // (l.a + r.a) score
  from cuts c join grams l on l.lang = c.lang and l.phrase = c.p join grams r on r.lang = c.lang and r.phrase = c.q),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (select lang, a, m, string_split(phrase, ' ') ws from grams where m > 2),
held as (select lang, array_to_string(ws[s:s+k-1], ' ') phrase, max(a) longer
  from (select *, unnest(range(1, m - k + 2)) s from (select *, unnest(range(2, m)) k from parts)) group by all),
kept as (select o.* from lowest o left join held h using (lang, phrase) where longer is null or 100 * longer < {WITHIN} * o.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) pos from kept)
select lang, pos::bigint as "rank", phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score
from ranked join totals using (lang) where pos <= {TOP}
"""
