"""Toxicity by noisy-channel deobfuscation.

Written text is taken as clean text that went through a channel: letters
replaced by look-alikes, letters repeated, letters spaced out or split by
marks. Each odd token (or run of spaced letters) becomes a character lattice;
a Viterbi search finds the likeliest letters under a character trigram model
of the whole corpus and the channel's costs. The restored words are scored.

Steps
1. Trigram counts over every text: each task sums its own, Spark adds them up
   (at most 64**3 rows, whatever the corpus).
2. Labelled rows outside the held-out fold: at most ``TOXIC`` toxic and
   ``CLEAN`` clean ones, near copies (similarity 0.75) of one text counted once
   in each class. Words and word beginnings of the toxic ones are the candidate
   features; texts are restored and features counted in tasks, and only those
   of a weight above ``LEAST`` reach the driver. A feature's weight is a lower
   bound of its log odds over the texts that no better feature explains. The
   prior is the log odds of all usable labels, whatever the sample's bounds.
3. Every whole text: the weights of its distinct restored words are summed with
   the prior's log odds, and a sigmoid gives the score. Tokens that can't be
   restored to a word with a weight aren't restored.

Definitions
- A null or empty text has the score of a text without evidence. Rows may repeat; equal texts
  have equal scores. Without labels of both kinds every score is 0.
- Labels with a null class or id are ignored. An id labelled both ways counts
  for both classes. Extra columns are ignored.
- A row is held out if crc32(doc_id as text) mod 3 is 1.
"""

from __future__ import annotations

import heapq
import math
import re
import weakref
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import op4_jaccard
from folio.llm.common import bounded_sample, id_mod, saved, sliced

#: Labelled rows that the classifier may learn from, by class.
TOXIC, CLEAN = 4000, 40_000
#: Features that a task counts before it hands them on.
COUNTED = 200_000
#: Least weight (nats) of a feature.
LEAST = 2.0
#: Letters by which words are told that have no feature.
HEAD = 5
#: Taken off the prior log odds: one weak word alone convicts no text.
CAUTION = 1.0
MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Look-alikes: what a written character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
#: Channel costs in nats: a look-alike, a dropped look-alike, mark or space, a dropped
#: repeat, a written sign that stays a break between words.
C_LIKE, C_DROP, C_MARK, C_SPACE, C_REPEAT, C_BREAK = 0.7, 7.0, 0.5, 1.0, 2.0, 1.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_OTHER = len(_LETTERS) + 1  # any other letter; 0 is a break
_LUT = np.zeros(0x250, np.int32)
for _c in range(0x250):
    _LUT[_c] = _CODE.get(chr(_c).lower(), _OTHER if chr(_c).isalpha() else 0)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")  # splits for str.split only
_SPACED = re.compile(r"(?<![^\x20\x09-\x0D])[^\W_](?:[\s.\-_*]+[^\W_]){2,}(?![^\x20\x09-\x0D])")
_EDGE_L, _EDGE_R = re.compile(r"^[^\w@$€£§¡(<+|!]+|^[!|(<+]+(?=[^\W\d_]{3})"), re.compile(r"[^\w@$]+$|[$@]{2,}$")
_GAP = re.compile(r"[\s.\-_*]+")
_TWICE = re.compile(r"([^\W\d_])\1+")
_AFTER = ".,;:?!%&#)"
_LOOSE = re.compile(r"(?:[^\W_](?![^\W_])|[\s.\-_*])+")  # no two letters or digits together


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams (coded) in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 ** 3, np.int64)
        for batch in sliced(batches, "text"):
            text = "\n\n".join([t or "" for t in batch.column("text").to_pylist()])
            cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            code = np.where(cp < 0x250, _LUT[np.minimum(cp, 0x24F)], _OTHER)
            if len(code) > 2:
                total += np.bincount((code[:-2] << 12) | (code[1:-1] << 6) | code[2:], minlength=64 ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(64 ** 3)
    got = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out[got["gram"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out


class Channel:
    """Restores tokens by Viterbi search under a trigram model."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(64, 64, 64)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + 64)
        p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
        self.logp = np.log((c3 + 8 * p2) / (c3.sum(2, keepdims=True) + 8)).reshape(-1).astype(np.float32).tolist()

    def options(self, text: str, i: int, whole: bool = False) -> list[tuple[int, float]]:
        """(code or -1 for nothing, cost) of the i-th character; with ``whole``,
        a look-alike must be a letter."""
        c = text[i]
        if c.isalpha():
            out = [(_CODE.get(c, _OTHER), 0.0)]
            if i and text[i - 1] == c:
                out.append((-1, C_REPEAT))
            return out
        if c == " ":
            return [(-1, C_SPACE), (0, 0.0)]
        like = LOOKALIKES.get(c, "")
        if whole and like:
            return [(_CODE[x], C_LIKE) for x in like]
        return [(_CODE[x], C_LIKE) for x in like] + [(-1, C_DROP if like else C_MARK), (0, C_BREAK)]

    def restore(self, text: str, whole: bool = False) -> str:
        """The likeliest letters, with spaces between words."""
        logp = self.logp
        beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # last two codes -> cost, (code, before)
        for i in range(len(text)):
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, path) in beam.items():
                for code, c in self.options(text, i, whole):
                    if code < 0:
                        to, total, way = state, cost + c, path
                    elif code == 0 and state & 63 == 0:
                        to, total, way = state, cost + c, path
                    else:
                        to, total, way = (state << 6 | code) & 4095, cost + c - logp[state << 6 | code], (code, path)
                    if to not in nxt or total < nxt[to][0]:
                        nxt[to] = (total, way)
            beam = nxt
        path = min(beam.items(), key=lambda x: (x[1][0] - logp[x[0] << 6], x[0]))[1][1]
        out = []
        while path:
            out.append(" " if path[0] == 0 else _LETTERS[path[0] - 1] if path[0] < _OTHER else "�")
            path = path[1]
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The restored words of one token of lower-cased text."""
        if token.isalpha() and not _TWICE.search(token):
            return [token]
        core = _EDGE_R.sub("", _EDGE_L.sub("", token))
        if core.isalpha():
            return [core] if not _TWICE.search(core) else [*dict.fromkeys([*self.restore(core).split(), core])]
        if not any(map(str.isalpha, core)):  # letters only if all its look-alikes are
            return self.restore(core, True).split() if any(c in LOOKALIKES for c in core) else []
        plain = [w for w in re.split(r"[\W\d_]+", core) if len(w) > 2]
        return [*dict.fromkeys([*self.restore(core).split(), *plain])]

    def text_words(self, text: str, memory: dict[str, tuple[str, ...]]) -> set[str]:
        """Distinct restored words of a whole text."""
        low = text.lower()
        out: set[str] = set()
        for token in set(_WORD.findall(low)):
            if (found := memory.get(token)) is None:
                found = memory[token] = tuple(self.words(token))
            out.update(found)
        for spaced in _SPACED.findall(low):
            out.update(self.restore(_GAP.sub(" ", spaced)).split())
        return out


def features(word: str) -> list[str]:
    """The word itself and its beginnings of three to eight letters."""
    return [f"={word}", *[word[:k] for k in range(3, 9) if len(word) > k]]


def _features(word):
    """``features`` as a column."""
    ks = F.filter(F.sequence(F.lit(3), F.lit(8)), lambda k: F.length(word) > k)
    return F.concat(F.array(F.concat(F.lit("="), word)), F.transform(ks, lambda k: F.substring(word, F.lit(1), k)))


def usable_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold whose document has a text."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
             .where(id_mod(F.col("doc_id"), MODULUS) != HELD_OUT))
    return saved(known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"))


def _sample(docs: DataFrame, known: DataFrame, toxic: int, bound: int) -> DataFrame:
    ids = bounded_sample(known.where(F.col("toxic") == toxic), "toxic", "doc_id", bound).select("doc_id")
    return (docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi")  # ``bound`` ids at most
            .select(F.xxhash64("text").alias("tid"), "text", F.lit(toxic).alias("toxic")))


def collapsed(rows: DataFrame) -> DataFrame:
    """``rows`` (tid, text, toxic), one of each near-duplicate component and class."""
    near = op4_jaccard.near_duplicates(rows.select(F.col("tid").alias("doc_id"), "text"))
    heads = (rows.select("tid", "toxic").join(near.select(F.col("doc_id").alias("tid"), "component_id").distinct(), "tid")
             .groupBy("component_id", "toxic").agg(F.min("tid").alias("tid")).select("tid", "toxic"))
    return rows.join(heads, ["tid", "toxic"], "left_semi").dropDuplicates(["tid", "toxic"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], float | None]:
    """(trigram counts, feature weights, prior log odds)."""
    counts = trigram_counts(docs)
    known = usable_labels(docs, labels)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return counts, {}, None
    sample = saved(collapsed(saved(_sample(docs, known, 1, TOXIC).union(_sample(docs, known, 0, CLEAN)))))
    taken = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    ratio = taken[0] / taken[1]
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = Channel(shared.value), {}
        for batch in sliced(batches, "text"):
            if len(memory) > 150_000:
                memory.clear()
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist()):
                found = sorted(own.text_words(text, memory))
                yield pa.RecordBatch.from_arrays([pa.array([tid] * len(found), pa.int64()), pa.array(found, pa.string())], ["tid", "word"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = Channel(shared.value), {}
        n: defaultdict[str, int] = defaultdict(int)

        def so_far() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["feature", "n"])
            n.clear()
            return out

        for batch in sliced(batches, "text"):
            if len(memory) > 150_000:
                memory.clear()
            for text in batch.column("text").to_pylist():
                for f in {f for w in own.text_words(text, memory) for f in features(w)}:
                    n[f] += 1
                if len(n) > COUNTED:
                    yield so_far()
        yield so_far()

    words = saved(sample.where("toxic = 1").select("tid", "text").mapInArrow(restored, "tid long, word string"))
    pairs = words.select("tid", "word", F.explode(_features(F.col("word"))).alias("feature"))
    toxic = pairs.groupBy("feature").agg(F.count_distinct("tid").alias("t")).where("t >= 3")
    clean = (sample.where("toxic = 0").select("text").mapInArrow(count, "feature string, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")))
    weight = F.log((F.col("t") - F.sqrt("t")) / (F.col("n") + 1.5) * F.lit(ratio))
    likely = saved(toxic.join(clean, "feature", "left").select("feature", "t", F.coalesce("n", F.lit(0)).alias("n")).where(weight > LEAST))
    wanted, against = {}, {}
    for r in likely.collect():
        wanted[r.feature], against[r.feature] = r.t, r.n
    place: dict[int, int] = {}
    at: dict[str, list[int]] = {}  # restored word -> toxic texts that have it
    of: defaultdict[str, list[str]] = defaultdict(list)
    for r in (pairs.join(likely, "feature", "left_semi").select("word", "tid").distinct()
              .groupBy("word").agg(F.array_sort(F.collect_set("tid")).alias("tids")).orderBy("word").toLocalIterator()):  # TOXIC at most a word
        at[r.word] = [place.setdefault(t, len(place)) for t in r.tids]
        for f in features(r.word):
            if f in wanted:
                of[f].append(r.word)
    return counts, explain(of, at, wanted, against, ratio), math.log(sizes[1] / sizes[0]) if sizes[1] < sizes[0] else 0.0


def explain(of: dict[str, list[str]], at: dict[str, list[int]], wanted: dict[str, int], against: dict[str, int],
            ratio: float) -> dict[str, float]:
    """Features and weights, best first: a feature counts the toxic texts whose
    words no better feature explains, so a beginning that is only common
    because of one toxic word earns nothing beside that word."""
    def weight(f: str, t: int) -> float:
        return math.log(max((t - math.sqrt(t)) / (against[f] + 1.5) * ratio, 1e-9))

    heap = [(-x, -len(f), f) for f, t in wanted.items() if (x := weight(f, t)) > LEAST]
    heapq.heapify(heap)
    done: set[str] = set()
    out = {}
    while heap:
        was, _, f = heapq.heappop(heap)
        rest = [w for w in of[f] if w not in done]
        now = weight(f, len({i for w in rest for i in at[w]}))
        if now < -was - 1e-9:
            if now > LEAST:
                heapq.heappush(heap, (-now, -len(f), f))
            continue
        out[f] = round(min(now, 8.0), 4)
        done.update(rest)
    return out


class Scorer:
    """Scores whole texts. A feature of a word and the word begin alike, so a
    token is restored only if some restoration of it can begin like a feature of
    the model; the others weigh nothing."""

    def __init__(self, model: tuple[np.ndarray, dict[str, float], float | None]) -> None:
        counts, self.weight, self.prior = model
        self.channel = Channel(counts)
        self.starts = {f.removeprefix("=")[:HEAD] for f in self.weight}
        self.bare = {_TWICE.sub(r"\1", x) for x in self.starts}  # a dropped repeat leaves this as it is
        self.memory: dict[str, tuple[tuple[str, float], ...]] = {}
        self.loose: dict[str, int] = {}  # tokens of ``memory`` that may be part of spaced letters, and their letters

    def evidence(self, words: list[str]) -> tuple[tuple[str, float], ...]:
        each = [(w, max([self.weight.get(f, 0.0) for f in features(w)])) for w in words if self.begins(w)]
        return tuple([(w, x) for w, x in each if x])

    def begins(self, word: str) -> bool:
        """Whether the word may have a feature."""
        return word[:HEAD] in self.starts or word[:3] in self.starts or word[:4] in self.starts

    def possible(self, token: str) -> bool:
        """Whether a restored word of the token may have a feature."""
        core = token.rstrip(_AFTER)
        if not core.isalpha():
            core = _EDGE_R.sub("", _EDGE_L.sub("", token))
            if not core.isalpha():
                return True
        head = core[:HEAD]
        if not head.isascii() and any(c not in _CODE for c in head):
            return True
        if not _TWICE.search(head):  # later repeats leave the beginning as it is
            return self.begins(core)
        if any(c not in _CODE for c in core):
            return True
        bare = _TWICE.sub(r"\1", core)
        return any(bare[:k] in self.bare for k in range(1, HEAD + 1))

    def remember(self, token: str) -> tuple[tuple[str, float], ...]:
        if not (len(token) > 1 and token[:2].isalnum()) and _LOOSE.fullmatch(token):
            self.loose[token] = sum(map(str.isalnum, token))
        got = self.memory[token] = self.evidence(self.channel.words(token)) if self.possible(token) else ()
        return got

    def spaced(self, parts: list[str]) -> bool:
        """Whether three letters in a row may be spaced."""
        run = 0
        for n in map(self.loose.get, parts):
            run = 0 if n is None else run + n
            if run > 2:
                return True
        return False

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """The texts' scores, and how many restored words weighed in."""
        memory, loose = self.memory, self.loose
        if len(memory) > 150_000:
            memory.clear()
            loose.clear()
        scores, used = [], []
        for text in texts:
            low = (text or "").lower()
            found: dict[str, float] = {}
            parts = _WORD.findall(low) if _OTHER_SPACE.search(low) else low.split()
            tokens = set(parts)
            for token in tokens:
                got = memory.get(token)
                if got is None:
                    got = self.remember(token)
                if got:
                    found.update(got)
            if not tokens.isdisjoint(loose) and self.spaced(parts):
                for spaced in _SPACED.findall(low):
                    found.update(self.evidence(self.channel.restore(_GAP.sub(" ", spaced)).split()))
            total = (self.prior or 0.0) - CAUTION + sum(sorted(found.values()))
            scores.append(0.0 if self.prior is None else round(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), 6))
            used.append(len(found))
        return scores, used


_KEPT: list = []


def _scorer(model: tuple[np.ndarray, dict[str, float], float | None]) -> Scorer:
    """The Python worker's scorer for ``model``: what it remembers of restored
    tokens (as bounded as ever) serves all of the worker's tasks, and goes with
    the broadcast's counts, which a worker drops at its first task without them."""
    if not _KEPT or _KEPT[0]() is not model[0] or _KEPT[1].weight is not model[1]:
        _KEPT[:] = weakref.ref(model[0], lambda _: _KEPT.clear()), Scorer(model)
    return _KEPT[1]


def _model(docs: DataFrame, labels: DataFrame):
    counts, weights, prior = fit(docs, labels)
    return docs.sparkSession.sparkContext.broadcast((counts.astype(np.float32), weights, prior))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id) with held_out, score, predicted and the number of
    distinct restored words that weighed in."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = _model(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in sliced(batches, "text"):
            scores, used = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(used, pa.int32())],
                                             ["doc_id", "score", "n_toxic_words"])

    return (docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_toxic_words int")
            .select("doc_id", F.coalesce(id_mod(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_toxic_words"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, unchanged."""
    shared = _model(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in sliced(batches, "text"):
            scores, _ = scorer(batch.column("text").to_pylist())
            yield batch.filter(pa.array([x < THRESHOLD for x in scores]))

    return docs.mapInArrow(run, docs.schema)
