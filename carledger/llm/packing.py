"""Packing documents into sequences at fixed source proportions.

Every source is a queue of tokens. Sequences are filled by deficit round
robin: each window of SEQUENCE tokens serves every source in turn, its
quantum being its share of the window, and what a source is still owed (a
fraction of a token) is carried to the next window. Documents are cut where
a quantum ends, so every window holds the target proportions to within a
few tokens.

The state of the round robin after any number of tokens has a closed form,
so windows need not be filled one after the other: the tokens served so far
are split between two halves of the sources in proportion, rounded down for
the first half, then within each half again. That never takes a token back,
gives every source its exact total at the end, and lets a task that knows
where its documents stand in their queues find their windows and offsets by
itself. The deficits thus pass over partitions without a sequential step.

With schedules the proportions change along the sequences: training time is
cut into steps, and what the schedules ask for between two of them is a phase
of its own. Queues then follow a given order instead of that of the scan.

Two passes: texts are tokenised once and written with their place in the
queue of their own task; token sums of (task, source) give each task's place
in the queues; the second pass cuts pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carledger.llm import mixing
from carledger.llm.common import WORKER_CACHES, bounded, by_name, numbered, only_caches_of, ship, sized_parts, stage

SEQUENCE = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words of a generation that a worker remembers with their ids (a cache;
#: results are the same without it).
CACHE_WORDS = 350_000
#: Rows of (task, source) sums that are broadcast; more of them are joined.
BROADCAST_ROWS = 500_000
TOKENISE_ROWS = 512
#: A run of these after a word of letters is a unit of its own. (A quote may
#: begin one with the letters that follow.)
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that are lower case and composed, if ``lower`` and ``isalpha`` say
#: so, in every version of Unicode.
LATIN = re.compile("[a-z\u00df-\u024f]+")
#: Steps of training time within which proportions hold still.
STEPS = 1024


class WordTokenizer:
    """Ids of a text as the concatenation of the ids of its words. The
    tokenizer cuts at white space itself and drops it, and lowers case, so
    lower-cased words between ASCII white space can be looked up one by one.
    Unseen words of letters are encoded many at a time: each is then one
    unit of the tokenizer, whose last id is one that ends a unit. Those of
    lower-case Latin letters need none of its normalising and cutting, only
    its model. Others are encoded alone, marks after a word of letters apart;
    a word is one of letters if it still is when the tokenizer has lower-cased
    it (a dotted capital I gets a mark that joins what follows). Strings of
    special tokens in a text are those tokens, as the tokenizer has it."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers
        path = name if os.path.sep in name else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        # Texts are cut at special strings first; what lower-casing makes
        # like one is ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = "<u2" if len(self.ends) <= 65536 else "<u4"
        self.special_ids = {t: np.array([i], self.kind).tobytes() for t, i in special.items()}
        # Two generations: words of the older one that come again move up.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes], tokenizer) -> None:
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            joined = b" ".join(some).decode()
            ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            last = ids.itemsize * (np.flatnonzero(self.ends[ids]) + 1)
            if len(last) == len(some):
                data, cut = ids.tobytes(), last.tolist()
                self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *cut[:-1]], cut))))
            else:
                self._alone(some)

    def _alone(self, words: list[bytes]) -> None:
        for w, ids in zip(words, self._ids([w.decode() for w in words])):
            self.known[w] = np.array(ids, self.kind).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, older = self.known, self.older
        for w in words.intersection(older):
            known[w] = older[w]
        new = words.difference(older)
        latin, letters, marked, alone = set(filter(bytes.isalpha, new)), set(), [], set()
        for w in new.difference(latin):
            core = w.rstrip(MARKS)
            kind = latin
            if not core.isalpha():      # of ASCII letters, lower case by now
                text = core.decode()
                lower = text.lower()
                if not lower.isalpha():
                    alone.add(w)
                    continue
                if lower != text or not LATIN.fullmatch(text):
                    kind = letters
            if core == w:
                kind.add(w)
            else:
                mark = w[len(core):]
                marked.append((w, core, mark))
                if core not in known:
                    if core in older:
                        known[core] = older[core]
                    else:
                        kind.add(core)
                if mark not in known:
                    alone.add(mark)
        self._letters(list(latin), self.model)
        self._letters(list(letters), self.tokenizer)
        self._alone(list(alone))
        for w, core, mark in marked:
            known[w] = known[core] + known[mark]

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian ids of each text, as ``kind`` says."""
        # Texts cut at special strings: the tokenizer takes those out first.
        texts = [t or "" for t in texts]
        marked = {i: self.special.findall(t) for i, t in enumerate(texts) if self.special and self.special.search(t)}
        plain = [t for i, t in enumerate(texts) if i not in marked]
        parts = [p for i in marked for p in self.special.split(texts[i])]
        words = [t.encode("utf-8", "replace").lower().split() for t in plain + parts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        self._learn(set().union(*words).difference(self.known))
        known = self.known.__getitem__
        ids = [b"".join(map(known, ws)) for ws in words]
        if not marked:
            return ids
        whole, rest = iter(ids[:len(plain)]), iter(ids[len(plain):])
        return [next(whole) if i not in marked else next(rest) + b"".join(self.special_ids[m] + next(rest) for m in marked[i])
                for i in range(len(texts))]


_TOKENIZERS: dict[str, WordTokenizer] = {}


WORKER_CACHES["packing"] = _TOKENIZERS.clear


def tokenizer(name: str) -> WordTokenizer:
    """One for each Python worker, which serves many tasks."""
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = WordTokenizer(name)
    return _TOKENIZERS[name]


TOKENS = "doc_id long, source string, h long, part int, place long, n long, ids binary"


def tokenise(docs: DataFrame, name: str = TOKENIZER, end_id: int = END_ID, order: Column | None = None) -> DataFrame:
    """One written row for each document: its ids with ``end_id``, its
    ``order``, its task, and its place among the task's tokens of its
    source."""
    ship(docs.sparkSession)

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_caches_of("packing")
        tok, part = tokenizer(name), TaskContext.get().partitionId()
        end = np.array([end_id], tok.kind).tobytes()
        at: dict[str | None, int] = {}
        for batch in it:
            for i in range(0, batch.num_rows, TOKENISE_ROWS):
                b = batch.slice(i, TOKENISE_ROWS)
                sources = b.column(1).to_pylist()
                ids = [x + end for x in tok.encode_batch(b.column(3).to_pylist())]
                n = [len(x) // len(end) for x in ids]
                place = []
                for s, k in zip(sources, n):
                    place.append(at.get(s, 0))
                    at[s] = place[-1] + k
                yield pa.record_batch([
                    b.column(0), pa.array(sources, pa.string()), b.column(2), pa.array([part] * len(n), pa.int32()),
                    pa.array(place, pa.int64()), pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "h", "part", "place", "n", "ids"])
    h = (F.lit(None) if order is None else order).cast("long").alias("h")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), h, "text")
    return stage(rows.mapInArrow(encoded, TOKENS), "tokens")


def phases(totals: Sequence[int], weights: Sequence[float]) -> list[list[int]]:
    """Tokens of each source in each phase. Within a phase proportions hold
    still; it ends when a source is used up. Sources without weight come
    last, in proportion to what they hold."""
    left, out = list(totals), []
    while any(left):
        active = [i for i, n in enumerate(left) if n and weights[i] > 0]
        if not active:
            out.append(list(left))
            break
        first = min(active, key=lambda i: left[i] / weights[i])
        time = left[first] / weights[first]
        now = [min(n, int(weights[i] * time)) if i in active else 0 for i, n in enumerate(left)]
        # Sources used up at the same time end exactly, rounding aside.
        now = [left[i] if i == first or i in active and left[i] - n < 1e-9 * left[i] + 1 else n for i, n in enumerate(now)]
        out.append(now)
        left = [a - b for a, b in zip(left, now)]
    return out


def scheduled(totals: Sequence[int], schedules: Sequence, steps: int = STEPS) -> list[list[int]]:
    """Tokens of each source in each step of training time: its total times
    what its schedule's integral grows by (knots as in ``mixing``). Sources
    without a schedule come last, in proportion to what they hold."""
    times = np.unique([k / steps for k in range(steps + 1)] + [t for s in schedules if s for t, _ in s])
    out = np.zeros((len(times), len(totals)), np.int64)
    for i, (n, knots) in enumerate(zip(totals, schedules)):
        if knots:
            t, w = np.array(knots, float).T
            area = np.concatenate([[0.0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])
            k = np.clip(np.searchsorted(t, times, "right") - 1, 0, len(t) - 2)
            x = times - t[k]
            share = (area[k] + w[k] * x + (w[k + 1] - w[k]) / (t[k + 1] - t[k]) * x * x / 2) / area[-1]
            out[:, i] = [min(n, max(0, int(n * float(y)))) for y in np.maximum.accumulate(share)]
            out[-1, i] = n
    plan = np.diff(out, axis=0).tolist()
    return [p for p in [*plan, [0 if s else n for n, s in zip(totals, schedules)]] if any(p)]


class Member(NamedTuple):
    """A source in its group: its number, the group's first number, last
    number + 1, tokens before its first source and after its last, and the
    tokens before each of the sources that halve the way to this one."""
    group: int
    number: int
    range: tuple[int, int, int, int]
    cuts: list[int]


def members(totals: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int, int, int]]]:
    """(a table of group, number and cuts of each source, ranges of groups)
    from (source, grp, n); only the groups come to the driver."""
    t = numbered(totals, [F.col("grp"), *by_name()], "n")
    ranges = {r["grp"]: (r["lo"], r["hi"], r["start"], r["end"]) for r in t.groupBy("grp").agg(
        F.min("_i").alias("lo"), (F.max("_i") + 1).alias("hi"), F.min("_before").alias("start"),
        F.max(F.col("_before") + F.col("n")).alias("end")).collect()}
    depth = max([hi - lo for lo, hi, _, _ in ranges.values()], default=1).bit_length() + 1
    edges = t.groupBy(F.col("grp").alias("_g")).agg(F.min("_i").alias("lo"), (F.max("_i") + 1).alias("hi"))
    first = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.array().cast("array<bigint>").alias("mids"))

    def halve(x: Column, _) -> Column:
        mid = F.shiftright(x["lo"] + x["hi"], 1)
        left = F.col("_i") < mid
        return F.when(x["hi"] - x["lo"] > 1, F.struct(
            F.when(left, x["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(x["hi"]).alias("hi"),
            F.concat(x["mids"], F.array(mid)).alias("mids"))).otherwise(x)
    mids = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), first, halve, lambda x: x["mids"])
    steps = t.join(edges, F.col("grp") == F.col("_g")).select(F.col("_i").alias("_k"), F.posexplode(mids).alias("level", "mid"))
    cuts = (steps.join(t.select(F.col("_i").alias("mid"), "_before"), "mid").groupBy("_k")
            .agg(F.sort_array(F.collect_list(F.struct("level", "_before")))["_before"].alias("cuts")))
    out = t.join(cuts, t["_i"] == cuts["_k"], "left").select(
        F.col("source").alias("_name"), "grp", F.col("_i").alias("number"), F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"))
    return stage(out, "members"), ranges


def share_of(k: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(k * part / whole), exact for 0 <= k, part <= whole < 2^52: a
    quotient in floating point is off by one at most, which the remainder
    shows; it is small, so that 64 bits hold it though not the product."""
    whole = np.maximum(whole, 1)
    q = (k.astype(float) * part / whole).astype(np.int64)
    with np.errstate(over="ignore"):
        r = k * part - q * whole
    step = (r >= whole).astype(np.int64) - (r < 0)
    return q + step


class RoundRobin:
    """Tokens of each source (or group of sources) among the first n tokens served, and the
    boundaries of sequences."""

    def __init__(self, plan: list[list[int]], length: int = SEQUENCE):
        self.plan, self.length = plan, length
        self.sources = len(plan[0]) if plan else 0
        self.total = sum(map(sum, plan))
        held = np.array(plan, np.int64).reshape(len(plan), self.sources)
        none = np.zeros((1, self.sources), np.int64)
        #: Of each phase: tokens of each source before it, sums over its
        #: sources, its first token and its last.
        self.before = np.concatenate([none, np.cumsum(held, axis=0)])
        self.sums = np.concatenate([np.zeros((len(plan), 1), np.int64), np.cumsum(held, axis=1)], axis=1)
        self.ends = np.cumsum(self.sums[:, -1])
        self.starts = self.ends - self.sums[:, -1]
        full = self.total // length
        tail, at = [], full * length
        for bit in reversed(range(length.bit_length())):
            # What is left after the last full sequence goes into sequences
            # of powers of two, which need no padding.
            if (self.total - full * length) >> bit & 1:
                at += 1 << bit
                tail.append(at)
        self.full, self.tail = full, tail

    @property
    def sequences(self) -> int:
        return self.full + len(self.tail)

    def bound(self, w):
        """Tokens served before sequence w (a number or an array)."""
        w = np.minimum(np.array(w, np.int64), self.sequences)
        tail = np.array([self.full * self.length, *self.tail], np.int64)
        return np.where(w <= self.full, w * self.length, tail[np.maximum(w - self.full, 0).astype(np.int64)])[()]

    def served(self, n) -> np.ndarray:
        """(len(n), sources): tokens of each source among the first n."""
        n = np.minimum(np.maximum(np.array(n, np.int64), 0), self.total)
        out = np.zeros((len(n), self.sources), np.int64)
        if not self.total:
            return out
        phase = np.minimum(np.searchsorted(self.ends, n), len(self.plan) - 1)
        sums = self.sums[phase]
        out += self.before[phase]

        def split(k, lo, hi):
            if hi - lo == 1:
                out[:, lo] += k
                return
            mid, whole = (lo + hi) // 2, sums[:, hi] - sums[:, lo]
            a = share_of(k, sums[:, mid] - sums[:, lo], whole)
            split(a, lo, mid)
            split(k - a, mid, hi)
        split(n - self.starts[phase], 0, self.sources)
        return out

    def own(self, source: Member, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens served before each sequence w: of the source, and of the
        sources before it. What its group is served is halved on the way to
        the source, as ``served`` does for the groups."""
        c = self.served(self.bound(w))
        k, others = c[:, source.group], c[:, :source.group].sum(axis=1)
        lo, hi, start, end = source.range
        for cut in source.cuts:
            mid = (lo + hi) // 2
            a = share_of(k, np.int64(cut - start), np.int64(end - start))
            if source.number < mid:
                k, hi, end = a, mid, cut
            else:
                k, others, lo, start = k - a, others + a, mid, cut
        return k, others

    def sequences_of(self, source: Member, place: np.ndarray) -> np.ndarray:
        """The sequences that hold tokens of a source's queue."""
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), self.sequences - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            here = self.own(source, mid)[0] <= place
            lo, hi = np.where(here, mid, lo), np.where(here, hi, mid - 1)
        return lo

    def cut(self, source: Member, place: np.ndarray, n: np.ndarray):
        """Pieces of documents of a source by their places in its queue:
        (document, start, length, sequence, offset) arrays."""
        first, last = np.split(self.sequences_of(source, np.concatenate([place, place + n - 1])), 2)
        k = last - first + 1
        doc = np.repeat(np.arange(len(n)), k)
        w = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k - first, k)
        (own, others), (own_end, others_end) = self.own(source, w), self.own(source, w + 1)
        start = np.maximum(place[doc], own)
        length = np.minimum(place[doc] + n[doc], own_end) - start
        some = length > 0
        return tuple(x[some] for x in (doc, start - place[doc], length, w, others_end - others + start - own))


PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def in_order(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their places in the queues of their sources: by round,
    then by the unsigned hash ``h``, then id. The k-th row with the same
    source, id and hash belongs to round k; texts without ids are all in the
    first. As in ``mixing``, a queue is cut by hash into about sqrt(n)
    buckets, whose sums are added up first."""
    buckets = max(1, int(tokens.count() ** 0.5))
    bucket = F.floor((F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0 ** -53)) * buckets).cast("long")
    copy = F.row_number().over(Window.partitionBy("source", "bucket", "h", "doc_id").orderBy("n")) - 1

    def rounds(t: DataFrame) -> DataFrame:
        # One shuffle serves both windows.
        dealt = t.withColumn("bucket", bucket).repartition(sized_parts(t), "source", "bucket")
        return dealt.withColumn("part", (F.when(F.col("n") > 1, copy).otherwise(0) * F.lit(buckets) + F.col("bucket")).cast("long"))
    sums = rounds(tokens.select("source", "h", "doc_id", "n")).groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bounded(stage(sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"),
                                      F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base")), "places"))
    before = (Window.partitionBy("source", "bucket", "part").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rounds(tokens).withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (placed.join(bases, (placed["part"] == bases["_part"]) & placed["source"].eqNullSafe(bases["_source"]))
            .withColumn("place", F.col("_base") + F.col("place")))


def pack(docs: DataFrame, weights: dict | None = None, length: int = SEQUENCE, name: str = TOKENIZER,
         end_id: int = END_ID, schedules: dict | mixing.Schedules | None = None, order: Column | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, source, text; others are ignored):
    where each lies in its document (start, length) and in its sequence
    (sequence_id, offset), and its ids (little-endian unsigned 32-bit).

    ``weights``: target proportions by source; without them those of the
    tokens there are, so that all queues end together. With them, a source
    that is used up leaves its share to the others; sources without weight
    come last. ``schedules`` (source to knots, as in ``mixing``) instead lets
    proportions follow training time, which runs over the sequences; within
    one of STEPS steps of it they hold still. ``order``: a 64-bit hash that
    orders every queue as ``mixing.allocate`` does, further copies of a row
    in further rounds; without it queues follow the scan. Sequences have ``length`` tokens, the last few powers of two,
    so none is padded. Null and empty texts are the end id alone; a very long
    text is cut over as many sequences as it takes; a null source is one
    more source; repeated rows are packed each; an empty table
    gives no pieces. Sources of one kind of schedule, or without a weight,
    are a group whose proportions hold still; the driver reads the totals of
    groups (with ``weights``, each source that has one is a group)."""
    tokens = tokenise(docs, name, end_id, order)
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = stage(sums.groupBy("source").agg(F.sum("n").cast("long").alias("n")), "totals")
    if schedules:
        plans = mixing.schedules_of(totals, schedules)
        kinds, knots = plans.table.select(F.col("source").alias("_s"), "kind"), plans.knots
    else:
        named = sorted((s for s, w in (weights or {}).items() if w > 0), key=lambda s: (s is None, s or ""))
        kinds = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(named)], "_s string, kind int")
        knots = named
    totals = totals.join(bounded(kinds), totals["source"].eqNullSafe(kinds["_s"]), "left").select(
        "source", "n", F.coalesce("kind", F.lit(len(knots))).alias("grp"))
    table, ranges = members(stage(totals, "groups"))
    held = [ranges[g][3] - ranges[g][2] if g in ranges else 0 for g in range(len(knots) + 1)]
    if schedules:
        plan = scheduled(held, [*knots, None])
    else:
        plan = phases(held, [*(weights[s] for s in knots), 0.0])
    if order is None:
        earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = stage(sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"),
                                  F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base")), "places")
        if bases.count() <= BROADCAST_ROWS:
            bases = F.broadcast(bases)
        placed = (tokens.join(bases, (tokens["part"] == bases["_part"]) & tokens["source"].eqNullSafe(bases["_source"]))
                  .withColumn("place", F.col("_base") + F.col("place")))
    else:
        placed = in_order(tokens)
    table = bounded(table)
    placed = placed.join(table, placed["source"].eqNullSafe(table["_name"]))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        robin = RoundRobin(plan, length)
        for batch in it:
            size = np.array(batch.column("n"))
            place = np.array(batch.column("place"))
            key = np.array(batch.column("number"))
            order = np.lexsort((place, key))
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if not len(own):
                    continue
                group, cuts = (batch.column(c)[int(own[0])].as_py() for c in ("grp", "cuts"))
                source = Member(group, int(key[own[0]]), ranges[group], cuts)
                for i in range(0, len(own), 512):
                    yield _pieces(batch, own[i:i + 512], robin.cut(source, place[own[i:i + 512]], size[own[i:i + 512]]))
    out = placed.select("doc_id", "source", "place", "n", "ids", "grp", "number", "cuts")
    return out.mapInArrow(cut, PIECES)


def _pieces(batch: pa.RecordBatch, rows: np.ndarray, pieces) -> pa.RecordBatch:
    doc, start, length, sequence, offset = pieces
    take = batch.take(pa.array(rows))
    size = np.array(take.column("n"))
    ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype("<u4").tobytes()
           for x, n in zip(take.column("ids").to_pylist(), size)]
    cut = [ids[d][4 * s:4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist())]
    at = pa.array(doc)
    return pa.record_batch([take.column("doc_id").take(at), take.column("source").take(at), pa.array(start), pa.array(length),
                            pa.array(size[doc]), pa.array(sequence), pa.array(offset), pa.array(cut, pa.binary())],
                           names=[x.split()[0] for x in PIECES.split(", ")])


def assemble(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences, at most SEQUENCE tokens each."""
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(
        whole, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed(docs: DataFrame, **how) -> DataFrame:
    """Per piece, with the checksum of its ids instead of them."""
    return pack(docs.select("doc_id", "source", "text"), **how).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
