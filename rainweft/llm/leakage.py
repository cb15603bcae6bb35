"""Evaluation passages that occur in a corpus.

Words of passages and documents are mapped to typed templates: numbers, names
and units become placeholders, other words stand for themselves. Windows of
twelve template words of all documents are hash-joined with those of all
passages, then their slots are compared: equal slots are a verbatim leak; slots
that differ by one consistent replacement are a question asked again with other
values.

Both sides are coded by one function of the word and of two filters made from
the passages, so a verbatim window has equal templates on both sides whatever
the filters hold. A third filter over the passages' window keys drops windows
of documents before they leave their task. Filters are bit maps whose size
follows the count of their entries up to MOST_BITS; a fuller map lets more
through to the join and loses nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.llm.mailtext import views
from rainweft.workspace import require, written

WINDOW = 12
FIXED = 6  # words of a window that stand for themselves, where other slot values are to count as a leak
WORD = re.compile(r"[^\W_]+")
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 29  # of a filter; 64 MB at most
BITS_EACH = 32
KNOWN_WORDS = 200_000  # held by a worker

# Units of measure in English, German, French, Spanish and Russian.
UNITS = frozenset(
    "mm cm m km kg g mg t l ml s ms min h hz khz mhz db dbz percent prozent hour hours minute minutes second seconds day days week weeks "
    "month months year years metre metres meter meters kilometre kilometres mile miles gram grams kilogram kilograms litre litres degree degrees "
    "stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren euro credits "
    "heure heures jour jours semaine semaines mois an ans mètre mètres litres hora horas día días semana semanas mes meses año años metros litros "
    "мм см м км кг г час часа часов минута минуты минут секунда секунды секунд день дня дней неделя недели недель месяц месяца месяцев год года лет метр метра метров".split()
)

# Words before a common noun; where such a word or a number stands before a capitalised word, that is no name.
BEFORE_NOUNS = frozenset(
    "the a an this that these those its his her their every each der die das den dem des ein eine einen einem einer eines kein keine keinen keinem jeder jede jedes jeden jedem "
    "im am zum zur vom beim dieser diese dieses diesen diesem le la les un une des du au aux el los las una unos unas".split()
)

_INSIDE = re.compile(r"([0-9]+)|([ァ-ヺー]{2,})")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


class Filter:
    """A bit map with two probes for each 63-bit hash."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.mask = np.uint64(bits - 1)
        self.map = np.zeros(bits // 8, np.uint8)
        for number, data in buckets.items():
            part = np.frombuffer(data, np.uint8)[: len(self.map) - (number - 1) * 4096]
            self.map[(number - 1) * 4096 : (number - 1) * 4096 + len(part)] = part
        self._bytes, self._mask = self.map.tobytes(), bits - 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.uint64)
        found = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(31)) & self.mask):
            found &= (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def holds(self, h: int) -> bool:
        a, b = h & self._mask, h >> 31 & self._mask
        return bool(self._bytes[a >> 3] >> (a & 7) & self._bytes[b >> 3] >> (b & 7) & 1)


def _filter(entries: DataFrame, column: str, n: int):
    """Broadcast filter of the hashes in a column; the driver sees its bit map only."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    h = F.col(column)
    at = entries.select(F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 31).bitwiseAND(bits - 1))).alias("at")).select((F.col("at") + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    return entries.sparkSession.sparkContext.broadcast((bits, {r["bucket"]: bytes(r["map"]) for r in maps.collect()}))


class Coder:
    """Template and exact code of words.

    names: filter of the words that are names in the passages; words: filter of
    all words of the passages; forms: filter of their template codes, without
    which every word counts as known; longest: letters of the longest word of the
    passages, beyond which no word is known.
    """

    def __init__(self, names: Filter, words: Filter, forms: Filter | None = None, window: int = WINDOW, longest: int = 1 << 30):
        self.names, self.words, self.forms, self.window, self.longest = names, words, forms, window, longest
        self._clear()

    def _clear(self) -> None:
        self._seen: dict[str, int] = {}
        self._form, self._exact, self._kind = array("Q"), array("Q"), array("B")  # kind: 0 unknown, 1 itself, 2 placeholder

    def _add(self, word: str) -> int:
        low = word.casefold()
        form, exact = None, 0
        if len(low) <= self.longest:
            exact = _hash(low)
            if low.isdigit():
                form = "#"
            elif low in UNITS:
                form = "#unit"
            elif self.words.holds(exact) and self.names.holds(exact):
                form = "#name"
            elif not low.isascii() and _UNSPACED.search(low):
                form = _INSIDE.sub(lambda m: "#" if m.group(1) else "#name", low)
            elif self.words.holds(exact):
                form = low
            elif word[:1].isupper() and word[1:].islower():
                form = "#name"
        code = 0 if form is None else exact if form == low else _hash(form)
        known = form is not None and (self.forms is None or form.startswith("#") or self.forms.holds(code))
        k = len(self._form)
        self._form.append(code)
        self._exact.append(exact)
        self._kind.append(0 if not known else 1 if form == low else 2)
        self._seen[word] = k
        return k

    def windows(self, text: str):
        """``(places, keys, exact, kind, at)`` of the windows of known words of a text.

        exact and kind are those of all words of the text; key is the hash of a
        window's templates, with its slots where fewer than FIXED words stand for
        themselves.
        """
        words = WORD.findall(text)
        n, w = len(words), self.window
        if n < w:
            return None
        if len(self._seen) > KNOWN_WORDS:
            self._clear()
        found = list(map(self._seen.get, words))
        if None in found:
            add, seen = self._add, self._seen
            found = [k if k is not None else seen[x] if x in seen else add(x) for k, x in zip(found, words)]
        found = np.array(found, np.int64)
        kind = np.frombuffer(self._kind, np.uint8)[found]
        gaps = np.concatenate([[0], np.cumsum(kind == 0)])
        at = np.flatnonzero(gaps[w:] == gaps[:-w])
        if not len(at):
            return None
        form, exact = np.frombuffer(self._form, np.uint64)[found], np.frombuffer(self._exact, np.uint64)[found]
        own = np.concatenate([[0], np.cumsum(kind == 1)])
        keys = self._rolled(form, at, w)
        few = np.flatnonzero(own[at + w] - own[at] < min(FIXED, w))
        if len(few):
            keys[few] = keys[few] * _BASE + self._rolled(exact, at[few], w)
        return at, keys >> np.uint64(1), exact, kind

    @staticmethod
    def _rolled(codes: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        mixed = codes * _MIX + np.uint64(1)
        for k in range(w):
            h = h * _BASE + mixed[at + k]
        return h ^ (h >> np.uint64(29))

    def slots(self, exact: np.ndarray, kind: np.ndarray, at: int) -> list[int]:
        """Exact codes of the placeholders of one window."""
        here = slice(at, at + self.window)
        return exact[here][kind[here] == 2].astype(np.int64).tolist()


def consistent(own: list[int], there: list[int]) -> bool:
    """Whether each slot value is replaced by one value throughout, and no two by the same."""
    to: dict = {}
    back: dict = {}
    return all(to.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(own, there))


_WORDS = "word bigint, name int, plain int, letters int"


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a batch of passages: whether it stands as a name, and as anything else."""
    for batch in batches:
        seen: dict[int, list[int]] = {}
        for value in batch.column(0):
            before = "."
            for m in WORD.finditer(value.as_py()):
                word = m.group()
                low = word.casefold()
                facts = seen.setdefault(_hash(low), [0, 0, len(low)])
                if word[:1].islower() or word[:1].isdigit() or before.casefold() in BEFORE_NOUNS or before.isdigit():
                    facts[1] = 1
                elif word[1:].islower() and before != ".":
                    facts[0] = 1
                before = word
        facts = [pa.array([f[k] for f in seen.values()], pa.int32()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *facts], names=["word", "name", "plain", "letters"])


def _item_windows(names, words, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(Filter(*names.value), Filter(*words.value), None, window)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, value in enumerate(batch.column(1)):
                got = own.windows(value.as_py())
                if got is None:
                    continue
                at, keys, exact, kind = got
                whole = own._rolled(exact, at, window).astype(np.int64)
                forms = np.frombuffer(own._form, np.uint64)[[own._seen[w] for w in WORD.findall(value.as_py())]]
                for k, place in enumerate(at.tolist()):
                    for col, v in zip(cols, (i, int(keys[k]), int(whole[k]), own.slots(exact, kind, place), forms.astype(np.int64).tolist() if k == 0 else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["pid", "win", "whole", "slots", "forms"],
            )

    return run


def _document_windows(names, words, forms, keys, window: int, longest: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = Coder(Filter(*names.value), Filter(*words.value), Filter(*forms.value), window, longest), Filter(*keys.value)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, value in enumerate(batch.column(1)):
                for part, text in enumerate(views(value.as_py())):
                    got = own.windows(text)
                    if got is None:
                        continue
                    at, win, exact, kind = got
                    hit = np.flatnonzero(wanted.has(win))
                    if not len(hit):
                        continue
                    whole = own._rolled(exact, at[hit], window).astype(np.int64)
                    for k, w in zip(hit.tolist(), whole.tolist()):
                        for col, v in zip(cols, (i, part, int(win[k]), w, own.slots(exact, kind, int(at[k])))):
                            col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64()))],
                    names=[key, "part", "win", "whole", "slots"],
                )

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot check of joined windows; those whose slots differ inconsistently go."""
    for batch in batches:
        own, there = batch.column("own_slots"), batch.column("slots")
        same = np.array(batch.column("own_whole").to_numpy() == batch.column("whole").to_numpy())
        ok = same.copy()
        for i in np.flatnonzero(~same).tolist():
            ok[i] = consistent(own[i].as_py(), there[i].as_py())
        keep = pa.array(np.flatnonzero(ok))
        names = [n for n in batch.schema.names if n not in ("own_slots", "slots")]
        yield pa.RecordBatch.from_arrays([batch.column(n).take(keep) for n in names] + [pa.array(same).take(keep)], names=[*names, "same"])


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", window: int = WINDOW) -> DataFrame:
    """``(key, item, kind, windows)``: a row per document and leaked item.

    kind is ``verbatim`` (at least ``window`` consecutive words of the passage)
    or ``changed`` (template windows only, with other slot values throughout and
    at least FIXED words that stand for themselves); windows is the number of
    matching windows in the text part where the most match. Searched are the raw
    text and its decoded text parts, in one pass over the documents whatever the
    number of items; only windows that some passage may hold are shuffled. Null
    or empty texts and passages, and passages below ``window`` words, leak
    nowhere; repeated items and documents of one key count once.
    """
    kinds = {c: documents.schema[c].dataType.simpleString() for c in (key,)}
    rows = require(documents, key, text).where(F.length(text) > 0)
    held = require(items, item, passage).where(F.length(passage) > 0).select(F.col(item).alias("_item"), F.md5(passage).alias("pid"), F.col(passage).alias("_passage"))
    passages = written(held.groupBy("pid").agg(F.first("_passage").alias("_passage")), "passages")
    lexicon = passages.select("_passage").mapInArrow(_lexicon, _WORDS).groupBy("word").agg(F.max("name").alias("name"), F.max("plain").alias("plain"), F.max("letters").alias("letters"))
    lexicon = written(lexicon, "lexicon")
    n, longest = lexicon.agg(F.count("*"), F.coalesce(F.max("letters"), F.lit(0))).first()
    names, words = _filter(lexicon.where("name = 1 and plain = 0"), "word", n), _filter(lexicon, "word", n)
    wins = written(passages.mapInArrow(_item_windows(names, words, window), "pid string, win bigint, whole bigint, slots array<bigint>, forms array<bigint>"), "windows")
    forms = _filter(wins.where("forms is not null").select(F.explode("forms").alias("form")).distinct(), "form", n)
    keys = _filter(wins, "win", wins.count())
    seen = rows.mapInArrow(_document_windows(names, words, forms, keys, window, longest, key), f"`{key}` {kinds[key]}, part int, win bigint, whole bigint, slots array<bigint>")
    own = wins.groupBy("win", F.col("whole").alias("own_whole")).agg(F.first("slots").alias("own_slots"))
    pairs = seen.join(own, "win").select(F.col(key), "part", "win", "whole", "slots", "own_whole", "own_slots")
    pairs = pairs.mapInArrow(_checked, f"`{key}` {kinds[key]}, part int, win bigint, whole bigint, own_whole bigint, same boolean")
    counts = pairs.groupBy(key, "part", "win", "own_whole").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("other"))
    places = wins.groupBy("pid", "win", F.col("whole").alias("own_whole")).agg(F.count("*").alias("_times")).drop("_times")
    by_part = counts.join(places, ["win", "own_whole"]).groupBy(key, "pid", "part").agg(F.sum("same").alias("same"), F.sum("other").alias("other"))
    best = by_part.groupBy(key, "pid").agg(F.max(F.struct("same", "other")).alias("best"))
    out = best.join(held.select("_item", "pid").distinct(), "pid")
    same, other = F.col("best.same"), F.col("best.other")
    return out.select(F.col(key), F.col("_item").alias(item), F.when(same > 0, "verbatim").otherwise("changed").alias("kind"), F.when(same > 0, same).otherwise(other).cast("int").alias("windows"))
