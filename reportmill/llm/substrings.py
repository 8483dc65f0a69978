"""Repeated passages: every run of words that an earlier document holds, to its exact edges (``dedup_runs``).

A text is its words, A-Z lower-cased; line ends and sentence ends are white space as any other. Each ``run_words`` words in a row are a window, and a
word goes when a window over it is a repeat: an earlier document holds that window, or the same text does, before and not overlapping it. So any run of
``run_words`` words or more that an earlier document holds goes from its first word to its last, wherever it starts and however short its lines and sentences are.

Windows are compared in two steps. Of the ``seed_words``-grams of a window the least by hash is its seed; equal windows have equal seeds, so windows whose seed
one document alone holds, once, are no repeats. Seeds (about a fifth of the words) are grouped first; then only windows
with a shared seed are hashed whole, grouped and kept apart by their positions. Both groupings are map-side combined minimums, and a seed or window that very many documents hold is dealt to several tasks; texts
move twice, to meet their shared seeds and the positions of their repeats.

Documents are ordered by ``doc_id``, null last; documents of one id (or null) among which alone a window is shared are ordered by their texts' hashes; a window that
later ids share as well stays in every text of the earliest id.

``dedup_passages`` is the older, coarser rule over units of lines. Units are parts of lines, so that a passage is found wherever it stands: a line is cut behind words that
end a sentence and behind anchor words (one in ``anchor`` by hash). Each cut depends on one word alone; a passage copied
into the middle of another line is cut alike from its first cut on. A unit's words are lower-cased (A-Z) and its digest covers them
joined by single spaces. Units of ``unit_words`` words or more are grouped by digest over all documents and the
earliest occurrence stays: the smallest ``doc_id``, then the first in its text. Later ones are marked. Marked units next to each other, with shorter units
between them, make a run; runs of ``run_words`` words or more are removed. Shorter ones stay, as chance and set phrases
repeat them in clean texts.

Spans are kept as code point offsets into the original text, from the first removed word to the end of the last one.

Two shuffles carry (digest, document) and no text; grouping is a map-side combined minimum, so a unit that a third of all
documents hold costs a row per task. Texts move once, to meet the digests they must give up.

Rows: null text stays null, has no units and is left as it is; a null id ranks behind all others; rows with one id and text are one document and
come out alike. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm import _common as c

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_ENDS = (b".", b"!", b"?", b":", b";")


class Units:
    """The units of one text: ``first`` and ``count`` of their words, and their digests."""

    def __init__(self, text: str | None, anchor: int):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        self.data, lower, digest = data, data.translate(c._ASCII_LOWER), xxhash.xxh3_64_intdigest
        self.first, self.count, self.digests = [], [], []
        n = 0
        self.lines = []  # (byte offset, first word's number) of each line that has words
        at = 0
        for line in lower.split(b"\n"):
            words = line.split()
            if words:
                self.lines.append((at, n))
                hashes = [*map(digest, words)]
                begin = 0
                for i, (w, h) in enumerate(zip(words, hashes), 1):
                    if i == len(words) or h % anchor == 0 or w.endswith(_ENDS):
                        self.first.append(n + begin)
                        self.count.append(i - begin)
                        self.digests.append(digest(b" ".join(words[begin:i])))
                        begin = i
                n += len(words)
            at += len(line) + 1
        self.words = n

    def byte_spans(self, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Byte spans of runs of words (first, end)."""
        if not runs:
            return []
        starts, ends = [], []
        for m in _WORD.finditer(self.data):
            starts.append(m.start())
            ends.append(m.end())
        return [(starts[a], ends[b - 1]) for a, b in runs]


def marked_runs(counts: list[int], marked: list[bool], unit_words: int, run_words: int) -> list[tuple[int, int]]:
    """(first, end) units of each run: from a marked unit to a marked one, with only marked or short units in it, long enough."""
    runs, begin, last = [], None, None
    for i, (n, m) in enumerate(zip(counts, marked)):
        if m:
            begin = i if begin is None else begin
            last = i
        elif n >= unit_words and begin is not None:
            runs.append((begin, last + 1))
            begin = None
    if begin is not None:
        runs.append((begin, last + 1))
    return [(a, b) for a, b in runs if sum(counts[a:b]) >= run_words]


def repeated_units(docs: DataFrame, unit_words: int = 4, anchor: int = 16) -> DataFrame:
    """(doc_id, text_key, gone): for each document with such units, the digests whose earliest holder is another one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            keys, digests, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                u = Units(text, anchor)
                own = {d for d, n in zip(u.digests, u.count) if n >= unit_words}
                digests.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
                sizes.append(len(own))
                keys.append(_text_key(text))
            yield [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(np.array(keys, np.int64), sizes), np.concatenate([*digests, np.empty(0, np.int64)])]

    ranked = docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), "text")
    units = c.cut(c.map_batches(ranked.where("text is not null"), work, "rank long, text_key long, digest long"), "units")
    # Rows with one id and text are one document: holders are told apart by both.
    first = units.groupBy("digest").agg(F.min("rank").alias("rank0"), F.max("rank").alias("rank9"), F.min("text_key").alias("key0"), F.max("text_key").alias("key9"))
    shared = first.where("rank0 <> rank9 or key0 <> key9").select("digest", "rank0")
    return c.cut(units.join(shared, "digest").where("rank > rank0").groupBy("rank", "text_key").agg(F.collect_set("digest").alias("gone")), "gone")


def _text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def dedup_passages(docs: DataFrame, unit_words: int = 4, run_words: int = 16, anchor: int = 16) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_units, n_words, removed_words, removed_spans ('from-to' code point
    offsets into the original, comma-joined) and original_chars."""
    return _dedup(docs, unit_words, run_words, anchor, [])


def _dedup(docs: DataFrame, unit_words: int, run_words: int, anchor: int, carried: list[str]) -> DataFrame:
    """With the columns in ``carried`` as ``__0``, ``__1`` and so on."""
    gone = repeated_units(docs, unit_words, anchor)
    made = "doc_id long, text string, n_units long, n_words long, removed_words long, removed_spans string, original_chars long"
    frame = docs.select("doc_id", "text", *[F.col(f).alias(f"__{i}") for i, f in enumerate(carried)])
    frame = frame.withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    # A document's list is one row for each id and text; ids alone nearly always tell them apart.
    lists = gone.groupBy("rank").agg(F.collect_list(F.struct("text_key", "gone")).alias("lists"))
    met = frame.join(lists, "rank", "left").drop("rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("lists").to_pylist()):
                if text is None:
                    rows.append((None, 0, 0, 0, "", 0))
                    continue
                u = Units(text, anchor)
                given = set()
                if lists is not None:
                    key = _text_key(text)
                    given = next((set(np.array(x["gone"], np.int64).view(np.uint64).tolist()) for x in lists if x["text_key"] == key), given)
                marked, seen = [], set()
                for d, n in zip(u.digests, u.count):
                    long = n >= unit_words
                    marked.append(long and (d in given or d in seen))
                    if long:
                        seen.add(d)
                runs = marked_runs(u.count, marked, unit_words, run_words) if True in marked else []
                spans = u.byte_spans([(u.first[a], u.first[b - 1] + u.count[b - 1]) for a, b in runs])
                left, at, said = [], 0, []
                for a, b in spans:
                    left.append(u.data[at:a])
                    at = b
                    begin = len(u.data[:a].decode("utf-8", "surrogatepass"))
                    said.append(f"{begin}-{begin + len(u.data[a:b].decode('utf-8', 'surrogatepass'))}")
                stays = b"".join([*left, u.data[at:]]).decode("utf-8", "surrogatepass") if spans else text
                rows.append((stays, len(u.first), u.words, sum(sum(u.count[a:b]) for a, b in runs), ",".join(said), len(text)))
            if rows:
                yield [batch.column("doc_id"), *zip(*rows), *[batch.column(f"__{i}") for i in range(len(carried))]]

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return c.map_batches(met, work, made + "".join(f", __{i} {kinds[f]}" for i, f in enumerate(carried)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    made, span = hashes, 1
    while span < size:
        step = min(span, size - span)
        made = _mix(made[: len(made) - step] * np.uint64(0x9E3779B97F4A7C15) + made[step:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(span + step))
        span += step
    return made


def _slide(x: np.ndarray, size: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each ``size`` values in a row."""
    span = 1
    while span < size:
        step = min(span, size - span)
        x = least(x[: len(x) - step], x[step:])
        span += step
    return x


class Windows:
    """The windows of ``run_words`` words of several texts, as arrays over all their words in a row."""

    def __init__(self, texts: list[str | None], run_words: int, seed_words: int):
        self.run_words, digest = run_words, xxhash.xxh3_64_intdigest
        words = [c.words_of(x) for x in texts]
        self.sizes = np.array([*map(len, words)], np.int64)
        n = int(self.sizes.sum())
        hashes = np.fromiter((digest(w) for x in words for w in x), np.uint64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(max(0, n - run_words + 1))
        self.whole = self.text[at] == self.text[at + run_words - 1]  # windows within one text
        if not len(at):
            self.grams = self.seeds = self.hashes = np.empty(0, np.uint64)
            return
        self.grams = _grams(hashes, seed_words)
        self.seeds = _slide(self.grams, run_words - seed_words + 1, np.minimum)  # each window's seed
        self.hashes = _grams(hashes, run_words)

    def owned(self, values: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """``values`` told apart by their texts."""
        return _mix(values + _mix(texts.astype(np.uint64) + np.uint64(1)))

    def distinct_seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, seed, again) of each text's distinct seeds; ``again``: it stands in two places."""
        if not len(self.seeds):
            return self.text[:0], self.seeds, self.whole[:0]
        span = len(self.grams) - len(self.seeds)
        # A gram is a seed when a window over it has no smaller one.
        known = np.concatenate([np.zeros(span, np.uint64), np.where(self.whole, self.seeds, 0), np.zeros(span, np.uint64)])
        at = np.flatnonzero(_slide(known, span + 1, np.maximum) == self.grams)
        _, first, times = np.unique(self.owned(self.grams[at], self.text[at]), return_index=True, return_counts=True)
        return self.text[at[first]], self.grams[at[first]], times > 1

    def candidates(self, texts: np.ndarray, seeds: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, position, own) of the windows whose seeds are among their text's ``seeds``, which lack their last ``shift`` bits; ``own``: the text holds it before, not overlapping it."""
        at = np.flatnonzero(self.whole)
        at = at[np.isin(self.owned(self.seeds[at] >> np.uint64(shift), self.text[at]), self.owned(seeds, texts))]
        text = self.text[at]
        _, first, which = np.unique(self.owned(self.hashes[at], text), return_index=True, return_inverse=True)
        return text, self.hashes[at], at - self.starts[text], at - at[first][which] >= self.run_words if len(at) else self.whole[:0]


#: What texts that share their id with no other text have in place of their hash.
_UNTIED = 2**63 - 1


def _text_keys(texts: list[str | None]) -> np.ndarray:
    return np.array([-1 if x is None else _text_key(x) for x in texts], np.int64)


def repeated_windows(docs: DataFrame, run_words: int = 16, seed_words: int = 8) -> DataFrame:
    """(node, tie, gone): for each document with such windows, the numbers of the first words of those that go. ``node`` is the document's id or, for null,
    its text's hash; ``tie`` is the text's hash where the id is null or has several texts."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            text, seed, again = Windows(batch.column(1).to_pylist(), run_words, seed_words).distinct_seeds()
            times = np.where(again, 2, 1)
            # Bits enough to tell most seeds apart: seeds that meet by chance only make more windows candidates.
            yield [np.repeat(batch.column(0).to_numpy()[text], times), np.repeat((seed >> np.uint64(24)).view(np.int64), times)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = batch.column("seeds")
            owner = np.repeat(np.arange(len(texts)), known.value_lengths().to_numpy())
            made = Windows(texts, run_words, seed_words)
            text, digest, at, own = made.candidates(owner, known.flatten().to_numpy().view(np.uint64), 24)
            rank, node, untied = batch.column("rank").to_numpy(), batch.column("node").to_numpy(), ~batch.column("tied").to_numpy(zero_copy_only=False)
            # Windows are many: what nearly all of them have in common is null, and so takes no room in tables and shuffles.
            yield [rank[text], pa.array(node[text], mask=(node == rank)[text]), pa.array(_text_keys(texts)[text], mask=untied[text]), digest.view(np.int64), at, own]

    named = _named(docs.where("text is not null").select("doc_id", "text"))
    seeded = c.cut_and_sweep(c.map_batches(named.select("node", "text"), seeds, "node long, digest long"), "seeds")
    shared = c.cut_and_sweep(seeded.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "shared-seeds")
    sets = c.salted_join(seeded, shared.select("digest"), "digest", seeded.count(), counts=shared).groupBy("node").agg(F.collect_set("digest").alias("seeds"))
    # Seeds and their shuffles go before texts and windows need the room.
    known = c.cut_and_sweep(sets, "seeds-by-document")
    c.free(seeded)
    c.free(shared)
    ids = docs.where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    sets = known.join(ids.where("a <> b").select(F.col("doc_id").alias("node"), F.lit(True).alias("many")), "node", "left")
    met = named.join(sets, "node").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), "node", (F.col("doc_id").isNull() | F.coalesce("many", F.lit(False))).alias("tied"), "text", "seeds")
    held = c.cut_and_sweep(c.map_batches(met, windows, "rank long, node long, tie long, digest long, at int, own boolean"), "windows")
    c.free(known)
    others = held.where("not own")
    first = others.groupBy("digest").agg(F.min("rank").alias("rank0"), F.max("rank").alias("rank9"), F.min("tie").alias("tie0"), F.count("*").alias("n")).where("rank0 <> rank9 or tie0 is not null")
    first = c.cut_and_sweep(first, "first-windows")
    later = (F.col("rank") > F.col("rank0")) | ((F.col("rank0") == F.col("rank9")) & (F.col("tie") > F.col("tie0")))
    holders = c.salted_join(others.select("digest", "rank", "node", "tie", "at"), first.drop("n"), "digest", held.count(), counts=first)
    marked = [F.coalesce("node", "rank").alias("node"), F.coalesce("tie", F.lit(_UNTIED)).alias("tie"), "at"]
    gone = holders.where(later).select(*marked).unionByName(held.where("own").select(*marked))
    out = c.cut_and_sweep(gone.groupBy("node", "tie").agg(F.collect_set("at").alias("gone")), "gone")
    c.free(held)
    c.free(first)
    return out


def _named(docs: DataFrame) -> DataFrame:
    """With ``node``, by which a document meets what was found for it; null ids are as many nodes as texts."""
    return docs.withColumn("node", F.coalesce("doc_id", F.xxhash64("text")))


def covered_runs(gone: list[int], run_words: int) -> list[tuple[int, int]]:
    """(first, end) words of the runs that windows from the words ``gone`` on cover."""
    at = np.sort(np.array(gone, np.int64))
    cuts = np.flatnonzero(np.diff(at) > run_words) + 1
    return [(int(x[0]), int(x[-1]) + run_words) for x in np.split(at, cuts) if len(x)]


def dedup_runs(docs: DataFrame, run_words: int = 16, seed_words: int = 8) -> DataFrame:
    """One row per document: doc_id, text (what stays), n_units (windows compared), n_words, removed_words, removed_spans ('from-to'
    code point offsets into the original, comma-joined) and original_chars."""
    return _dedup_runs(docs, run_words, seed_words, [])


def _dedup_runs(docs: DataFrame, run_words: int, seed_words: int, carried: list[str]) -> DataFrame:
    """With the columns in ``carried`` as ``__0``, ``__1`` and so on."""
    gone = repeated_windows(docs, run_words, seed_words)
    made = "doc_id long, text string, n_units long, n_words long, removed_words long, removed_spans string, original_chars long"
    frame = docs.select("doc_id", "text", *[F.col(f).alias(f"__{i}") for i, f in enumerate(carried)])
    lists = gone.groupBy("node").agg(F.collect_list(F.struct("tie", "gone")).alias("lists"))
    met = _named(frame).join(lists, "node", "left").drop("node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("lists").to_pylist()):
                if text is None:
                    rows.append((None, 0, 0, 0, "", 0))
                    continue
                n = len(c.words_of(text))
                tie = _text_key(text) if lists else None
                runs = covered_runs(next((x["gone"] for x in lists or () if x["tie"] in (_UNTIED, tie)), []), run_words)
                stays, said = _without(text, runs)
                rows.append((stays, max(0, n - run_words + 1), n, sum(b - a for a, b in runs), said, len(text)))
            if rows:
                yield [batch.column("doc_id"), *zip(*rows), *[batch.column(f"__{i}") for i in range(len(carried))]]

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return c.map_batches(met, work, made + "".join(f", __{i} {kinds[f]}" for i, f in enumerate(carried)))


def _without(text: str, runs: list[tuple[int, int]]) -> tuple[str, str]:
    """The text without runs of words (first, end), and their code point offsets."""
    if not runs:
        return text, ""
    data = text.encode("utf-8", "surrogatepass")
    spans = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    left, at, place, said = [], 0, 0, []
    for a, b in runs:
        begin, end = spans[a][0], spans[b - 1][1]
        kept, cut = data[at:begin].decode("utf-8", "surrogatepass"), data[begin:end].decode("utf-8", "surrogatepass")
        left.append(kept)
        said.append(f"{place + len(kept)}-{place + len(kept) + len(cut)}")
        at, place = end, place + len(kept) + len(cut)
    return "".join([*left, data[at:].decode("utf-8", "surrogatepass")]), ",".join(said)


def drop_repeats(docs: DataFrame, run_words: int = 16, seed_words: int = 8) -> DataFrame:
    """The documents, with their columns, without repeated passages; ``n_chars`` follows the text. A document of
    which nothing but white space stays is left out; one that had no words to begin with is kept."""
    carried = [x for x in docs.columns if x not in ("doc_id", "text")]
    out = _dedup_runs(docs, run_words, seed_words, carried).where("removed_words = 0 or removed_words < n_words")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {x: F.col(f"__{i}") for i, x in enumerate(carried)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[x].alias(x) for x in docs.columns])
