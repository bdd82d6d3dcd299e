"""Garbled text from wrong character encoding.

Adjacent character pairs are scored by their mutual information over the whole corpus. Maximum-scoring segments of
improbable pairs are cut out of each text, and only inside those runs inverse mappings are tried: the run is written
back to the bytes it may have come from and read again in the encoding they may have had. A mapping holds where the
characters it gives are far more probable, pair for pair, than those it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.session import materialise

PAIR_BITS, CHAR_BITS = 22, 16


@dataclass(frozen=True)
class RepairConfig:
    """Thresholds, in bits of probability per adjacent pair of characters."""

    improbable: float = 1e-4  # pairs that carry less mutual information than this score positive
    improbable_odd: float = 1e-2  # the same for pairs outside ASCII: damage in many like texts is not to pass for normal
    clip: float = 4.0
    gain_utf8: float = 16.0  # of a whole run, or of all runs of a text, with what its valid sequences are worth
    valid: float = 6.0  # what it is worth that a stretch outside ASCII is wholly valid UTF-8
    gain_table: float = 3.0  # of the mean pair of a piece, where one single-byte table is taken for another
    strange: float = 15.0  # bits that a character costs which a reading brings in and no text of the corpus has
    covered: float = 0.66  # of a stretch of characters outside ASCII, what a reading must account for
    gain_weak: float = 1.0  # the same, once the text has been found to be misread so
    gain_text: float = 12.0  # of such a mapping over all runs of a text
    reach: int = 12  # characters around one outside ASCII that are scored
    least_sequences: int = 2  # valid multi-byte sequences, and nothing else outside ASCII, that prove a run to be UTF-8
    slice_chars: int = 1 << 20  # characters of several texts that are scored at a time


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _char_slot(a: np.ndarray) -> np.ndarray:
    return np.where(a < 0x10000, a, (a ^ (a >> 5)) & 0xFFFF).astype(np.int64)


def pair_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows (kind, slot, n): counts of adjacent pairs and of characters over all texts, in a table of bounded size.

    Slots are hashes, so there are at most 2**22 and 2**16 whatever the corpus holds. Equal texts count once, or a
    garbled text with many copies would make its own damage probable; they are reduced within each task before they
    are shuffled. Line ends count as the neighbours of a text's first and last character.
    """
    known = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))
    once = known.dropDuplicates(["h", "n"]).select("t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, chars = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
        for b in batches:
            joined = _codes("\n".join(["", *(t for t in b.t if t), ""]))
            for s in range(0, len(joined), 1 << 22):
                part = joined[s : s + (1 << 22) + 1]
                chars += np.bincount(_char_slot(part[:-1]), minlength=1 << CHAR_BITS)
                pairs += np.bincount(_pair_slot(part[:-1], part[1:]), minlength=1 << PAIR_BITS)
        for kind, n in ((0, pairs), (1, chars)):
            at = np.flatnonzero(n)
            yield pd.DataFrame({"kind": np.full(len(at), kind, "int32"), "slot": at.astype("int32"), "n": n[at]})

    parts = once.mapInPandas(count, "kind int, slot int, n bigint")
    return parts.groupBy("kind", "slot").agg(F.sum("n").alias("n"))


class PairModel:
    """Pair and character counts as lookup tables."""

    def __init__(self, kind: np.ndarray, slot: np.ndarray, n: np.ndarray):
        pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS)
        pairs[slot[kind == 0]] = n[kind == 0]
        chars[slot[kind == 1]] = n[kind == 1]
        self.total = max(float(pairs.sum()), 1.0)
        self.attested = float(np.log2(2.5 / self.total))  # log probability of a pair that was met three times
        self.log_pairs = np.log2((pairs + 0.02) / self.total).astype("float32")
        self.unmet_pair = float(np.log2(0.5 / self.total))
        self.of_pair: dict[str, float] = {}
        self.log_chars = np.log2((chars + 0.5) / self.total).astype("float32")
        self.never = float(np.log2(0.6 / self.total))
        self.unmet: dict[str, bool] = {}

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of every adjacent pair; a pair that was never met is the likelier the more frequent its characters are."""
        lp = self.log_pairs[_pair_slot(codes[:-1], codes[1:])]
        single = self.log_chars[_char_slot(codes)]
        return lp + np.where(lp < self.unmet_pair, np.clip((single[:-1] + single[1:]) / 2 + 12, -3, 3), 0)

    def improbability(self, a: np.ndarray, b: np.ndarray, config: RepairConfig) -> np.ndarray:
        """Positive where the pair of a and b carries little of the corpus' mutual information, negative where it carries much."""
        lp = self.log_pairs[_pair_slot(a, b)]
        mutual = lp - self.log_chars[_char_slot(a)] - self.log_chars[_char_slot(b)]
        information = np.exp2(lp) * np.maximum(mutual, 0.0)  # a pair whose characters avoid each other carries none
        rare = np.where((a > 127) | (b > 127), config.improbable_odd, config.improbable)
        rare = np.maximum(rare, 3 * np.log2(self.total + 1) / self.total)  # in a small corpus, what was met three times at most
        return np.clip(np.log2(rare / np.maximum(information, 1e-12)), -config.clip, config.clip)

    def strange(self, new: str, old: str) -> int:
        """How many different characters of new that old has not were never met in the corpus."""
        count = 0
        for c in set(new) - set(old):
            if c not in self.unmet:
                self.unmet[c] = bool(self.log_chars[_char_slot(_codes(c))][0] < self.never)
            count += self.unmet[c]
        return count

    def bits(self, text: str) -> tuple[float, float]:
        """Sum and mean of the log probability of the adjacent pairs of text."""
        if len(text) < 2:
            return 0.0, 0.0
        if len(text) > 100:
            lp = self.log_probability(_codes(text))
            return float(lp.sum()), float(lp.mean())
        total = 0.0
        for i in range(len(text) - 1):  # short pieces, of few different pairs: cheaper than arrays
            pair = text[i : i + 2]
            lp = self.of_pair.get(pair)
            if lp is None:
                lp = self.of_pair[pair] = float(self.log_probability(_codes(pair))[0])
            total += lp
        return total, total / (len(text) - 1)


_BREAK = -1e6  # a score that no segment reaches over


def max_scoring_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [begin, end) in order (Ruzzo and Tompa), over runs of one sign."""
    if not len(scores):
        return []
    positive = scores > 0
    cuts = np.flatnonzero(np.diff(positive)) + 1
    begins, ends = np.append(0, cuts), np.append(cuts, len(scores))
    sums = np.add.reduceat(scores, begins)
    out: list[tuple[int, int]] = []
    found: list[tuple[float, float, int, int]] = []  # total before, total after, begin, end
    total = 0.0
    for begin, end, s in zip(begins.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            if s <= _BREAK / 2:  # what stands before can no longer change
                out += [(b, e) for _, _, b, e in found]
                found, total = [], 0.0
            continue
        left, right = total, total + s
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, begin, end))
                break
            left, begin = found[j][0], found[j][2]
            del found[j:]
    return out + [(b, e) for _, _, b, e in found]


def _table(encoding: str, controls: bool = False) -> dict[str, int]:
    """Character to byte for a single-byte encoding; with controls, undefined bytes stand for themselves."""
    out = {}
    for byte in range(128, 256):
        try:
            out[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            if controls:
                out[chr(byte)] = byte
    if controls:
        for byte in range(128, 160):
            out.setdefault(chr(byte), byte)
    return out


# The encodings that UTF-8 bytes are commonly misread as, and pairs (misread as, really) of others.
UTF8_MISREAD_AS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "cp1257", "cp852")
UTF8_MISREAD_AS_MULTIBYTE = ("cp932", "gbk")
MISREAD_TABLES = (
    ("cp1252", "cp1251"),
    ("cp1251", "koi8-r"),
    ("koi8-r", "cp1251"),
    ("cp1252", "koi8-r"),
    ("cp1251", "cp866"),
    ("cp866", "cp1251"),
    ("cp1252", "cp866"),
    ("cp1251", "cp1252"),
    ("cp1252", "cp1250"),
    ("cp1252", "iso8859-2"),
    ("cp1250", "cp1252"),
    ("cp1252", "cp1258"),
    ("cp437", "cp1252"),
    ("mac_roman", "cp1252"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
)
MULTIBYTE = (("cp1252", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "cp932"), ("latin-1", "euc_jp"))


def _class(chars: list[str]) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


class _Utf8:
    """UTF-8 bytes read in a single-byte encoding."""

    def __init__(self, encoding: str):
        self.name = f"utf-8 read as {encoding}"
        self.table = _table(encoding, controls=encoding in ("cp1252", "latin-1", "cp1251", "cp1250", "cp1254", "cp1257"))
        of = lambda lo, hi: _class([c for c, b in self.table.items() if lo <= b <= hi])
        tail = of(0x80, 0xBF)
        self.pattern = re.compile(f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}})+")
        # a sequence cut short; only where no word of the encoding's own languages has such a letter before such a sign
        self.cut = re.compile(f"{of(0xE0, 0xEF)}{tail}(?!{tail})|{of(0xC2, 0xC3)}[ \ufffd]") if encoding in ("cp1252", "latin-1") else None

    def read(self, piece: str) -> str:
        try:
            return bytes(self.table[c] for c in piece).decode("utf-8")
        except UnicodeDecodeError:
            return piece


class _Utf8Multibyte:
    """UTF-8 bytes read in an encoding of one or two bytes a character."""

    pattern = re.compile(r"[^\x00-\x9f]+")

    def __init__(self, encoding: str):
        self.name, self.encoding = f"utf-8 read as {encoding}", encoding
        self.cut = None

    def read(self, piece: str) -> str:
        try:
            return piece.encode(self.encoding).decode("utf-8")
        except UnicodeError:
            return piece


class _Table:
    """Bytes of one encoding read in another; really may be a multi-byte encoding."""

    def __init__(self, misread: str, really: str, multibyte: bool = False):
        self.name = f"{really} read as {misread}"
        self.table = _table(misread, controls=misread in ("cp1252", "latin-1"))
        self.really, self.multibyte = really, multibyte
        high = _class(list(self.table))
        if multibyte:
            tail = r"[\x40-\x7e" + high[1:]
            self.pattern = re.compile(f"(?:{high}{tail})+{high}*")
        else:
            self.pattern = re.compile(f"{high}+")

    def read(self, piece: str) -> str:
        data = bytes(self.table.get(c, ord(c) & 0x7F) for c in piece)
        try:
            return data.decode(self.really)
        except UnicodeDecodeError:
            if not self.multibyte:
                return piece
            try:  # a last high byte may belong to what follows
                return data[:-1].decode(self.really) + piece[-1]
            except UnicodeDecodeError:
                return piece


_LETTERS = {"latin": "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "other": "\u0530-\u1dff"}
_MIXED = re.compile("|".join(f"[{a}][{b}]" for m, a in _LETTERS.items() for n, b in _LETTERS.items() if m != n))
_ODD = re.compile("[^\\x00-\\x7f]+")
_CONTROL = re.compile("[\x80-\x9f\ue000-\uf8ff]")  # and characters of no meaning


def _foreign(new: str, old: str) -> bool:
    """Whether new has a control or private character that old has not, or letters of two alphabets side by side more often."""
    if any(c not in old for c in _CONTROL.findall(new)):
        return True
    return len(_MIXED.findall(new)) > len(_MIXED.findall(old))


def _healed(new: str, old: str) -> bool:
    """Whether a sign inside a word, other than those that words may have, has become a letter; both have the same length."""
    return len(new) == len(old) and any(
        new[i - 1 : i + 2].isalpha() and not old[i].isalpha() and old[i] not in "’‘ʼ·‐‑" and old[i - 1].isalpha() and old[i + 1].isalpha() for i in range(1, len(old) - 1)
    )


def _torn(new: str, old: str) -> bool:
    """Whether a letter between letters has become something else; both have the same length."""
    return len(new) == len(old) and any(old[i - 1 : i + 2].isalpha() and new[i - 1].isalpha() and new[i + 1].isalpha() and not new[i].isalpha() for i in range(1, len(old) - 1))


@dataclass(frozen=True)
class _Reading:
    """What one mapping makes of a run."""

    new: str
    mapping: _Utf8 | _Utf8Multibyte | _Table
    gain: float  # bits, and what valid sequences are worth
    likely: bool  # not by the mere number of characters, or one odd sign alone
    changed: tuple[str, ...] = ()  # pieces that a table changed, a few of them


class Repairer:
    """Finds and restores the garbled runs of texts under one pair model."""

    def __init__(self, model: PairModel, config: RepairConfig = RepairConfig()):
        self.model, self.config = model, config
        self.utf8 = [_Utf8(e) for e in UTF8_MISREAD_AS] + [_Utf8Multibyte(e) for e in UTF8_MISREAD_AS_MULTIBYTE]
        self.tables = [_Table(a, b) for a, b in MISREAD_TABLES] + [_Table(a, b, True) for a, b in MULTIBYTE]
        self.known: dict[str, list[_Reading]] = {}
        self.pieces: dict[tuple, str] = {}
        self.stretches: dict[tuple, tuple[list[int], list[int]]] = {}

    def _restore(self, mapping: _Utf8 | _Utf8Multibyte | _Table, run: str, least: float | None) -> str:
        """The run with every piece read anew that the mapping can read; with least, only pieces that gain as much in the mean."""

        if not isinstance(mapping, _Table):
            return _ODD.sub(lambda m: self._stretch(mapping, least, run[max(m.start() - 1, 0) : m.start()], m.group(), run[m.end() : m.end() + 1]), run)

        def piece(m: re.Match) -> str:
            before, after = run[max(m.start() - 1, 0) : m.start()], run[m.end() : m.end() + 1]
            return self._piece(mapping, least, before, m.group(), after)

        return mapping.pattern.sub(piece, run)

    def _stretch(self, mapping: _Utf8 | _Utf8Multibyte, least: float | None, before: str, old: str, after: str) -> str:
        """A stretch of characters outside ASCII; wrongly read, nearly all of it is valid sequences."""
        if sum(len(m.group()) for m in mapping.pattern.finditer(old)) < self.config.covered * len(old):
            return old
        if least is None:
            return mapping.pattern.sub(lambda m: mapping.read(m.group()), old)
        edge = lambda i: old[i] if 0 <= i < len(old) else before if i < 0 else after
        return mapping.pattern.sub(lambda m: self._piece(mapping, least, edge(m.start() - 1), m.group(), edge(m.end())), old)

    def _piece(self, mapping: _Utf8 | _Utf8Multibyte | _Table, least: float, before: str, old: str, after: str) -> str:
        """What the mapping makes of a piece, if that gains as much in the mean; remembered."""
        key = (mapping.name, least, before, old, after)
        if key in self.pieces:
            return self.pieces[key]
        if len(self.pieces) > 500_000:
            self.pieces.clear()
        new = mapping.read(old)
        was, now = before + old + after, before + new + after
        if new != old and (self.model.bits(now)[1] - self.model.bits(was)[1] < least or _foreign(now, was)):
            new = old
        if new != old and isinstance(mapping, _Table) and (not self._attested(now, was) or _torn(now, was)):
            new = old
        self.pieces[key] = new
        return new

    def _candidates(self, run: str) -> tuple[list[_Utf8 | _Utf8Multibyte], list[_Table]]:
        """The mappings that can read any stretch of the run outside ASCII; remembered by stretch."""
        utf8, tables = set(), set()
        for m in _ODD.finditer(run):
            stretch = m.group()
            key = (run[max(m.start() - 1, 0) : m.start()], stretch, run[m.end() : m.end() + 1])
            if key not in self.stretches:
                if len(self.stretches) > 200_000:
                    self.stretches.clear()
                part = "".join(key)
                self.stretches[key] = (
                    [i for i, u in enumerate(self.utf8) if self._stretch(u, None, *key) != stretch],
                    [i for i, t in enumerate(self.tables) if t.multibyte or self._restore(t, part, self.config.gain_table) != part],
                )
            utf8.update(self.stretches[key][0])
            tables.update(self.stretches[key][1])
        return [self.utf8[i] for i in sorted(utf8)], [self.tables[i] for i in sorted(tables) if not self.tables[i].multibyte or self.tables[i].pattern.search(run)]

    def _readings(self, run: str) -> list[_Reading]:
        """The best reading of every mapping that makes a run (given with one character of context on both sides) likelier."""
        utf8, tables = self._candidates(run)
        if not utf8 and not tables:
            return []
        old_sum, old_mean = self.model.bits(run)
        strange = lambda new: self.config.strange * self.model.strange(new, run)
        out = []
        for mapping in utf8:
            # by likely pieces; whole, though a piece may be no likelier; and again, each time shorter, as long as it can be read
            ways, new = {self._restore(mapping, run, 0.0)}, self._restore(mapping, run, None)
            while new not in ways:
                ways.add(new)
                new = self._restore(mapping, new, None)
            best = None
            stretches = _ODD.findall(run)
            for new in sorted(ways - {run}):
                if _foreign(new, run):
                    continue
                new_sum, new_mean = self.model.bits(new)
                gain = new_sum - old_sum - strange(new) + self.config.valid * (len(stretches) - sum(t in stretches for t in _ODD.findall(new)))
                if gain > 0 and (best is None or gain > best.gain):
                    likely = new_mean >= old_mean or self._attested(new, run) or self._whole(mapping, run)
                    best = _Reading(new, mapping, gain, likely)
            if best:
                out.append(best)
        for mapping in tables:
            new = self._restore(mapping, run, self.config.gain_table)
            gain = self.model.bits(new)[0] - old_sum - strange(new)
            if new != run and gain > 0:
                changed = {m.group() for m in mapping.pattern.finditer(run) if new[m.start() : m.end()] != m.group()} if len(new) == len(run) else {run}
                out.append(_Reading(new, mapping, gain, max(map(len, changed), default=0) >= 3 or _healed(new, run), tuple(sorted(changed)[:4])))
        return out

    def _whole(self, mapping: _Utf8 | _Utf8Multibyte, run: str) -> bool:
        """Whether every character outside ASCII is part of a valid sequence, and there are so many that it is no chance."""
        pieces = list(mapping.pattern.finditer(run))
        odd = sum(ord(c) > 127 for c in run)
        return sum(len(p.group()) for p in pieces) == odd and sum(len(mapping.read(p.group())) for p in pieces if mapping.read(p.group()) != p.group()) >= self.config.least_sequences

    def _attested(self, new: str, old: str) -> bool:
        """Whether nearly all pairs with a character that old has not are known from the corpus."""
        came = set(new) - set(old)
        pairs = {new[i : i + 2] for i in range(len(new) - 1) if new[i] in came or new[i + 1] in came}
        known = sum(float(self.model.log_probability(_codes(p))[0]) >= self.model.attested for p in pairs)
        return bool(pairs) and known >= 0.9 * len(pairs)

    def _remembered(self, run: str) -> list[_Reading]:
        """_readings, kept for the short runs that come again and again."""
        if len(run) > 200:
            return self._readings(run)
        if run not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[run] = self._readings(run)
        return self.known[run]

    def runs(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text the improbable runs [begin, end) of characters that hold one outside ASCII, wholly."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(i)
            size += len(text)
            if size >= self.config.slice_chars or i == len(texts) - 1:
                for number, run in self._runs([texts[j] for j in held]):
                    out[held[number]].append(run)
                held, size = [], 0
        return out

    def _runs(self, texts: list[str]) -> Iterator[tuple[int, tuple[int, int]]]:
        """(number of the text, run). All texts are scored as one array.

        Only pairs near a character outside ASCII are scored; a segment without one would be no run. A replacement
        character is always improbable.
        """
        codes = _codes("\n" + "\n\n".join(texts) + "\n")
        starts = np.cumsum([1, *(len(t) + 2 for t in texts[:-1])])
        odd = codes > 127
        if not odd.any():
            return
        counts = np.concatenate([[0], np.cumsum(odd)])
        reach = self.config.reach
        i = np.arange(len(codes) - 1)
        near = counts[np.minimum(i + 2 + reach, len(codes))] > counts[np.maximum(i - reach, 0)]
        near[starts[1:] - 2] = False  # between two texts
        near = np.flatnonzero(near)
        scores = self.model.improbability(codes[near], codes[near + 1], self.config)
        scores[(codes[near] == 0xFFFD) | (codes[near + 1] == 0xFFFD)] = self.config.clip
        gaps = np.flatnonzero(np.diff(near) > 1) + 1
        scores, near = np.insert(scores, gaps, _BREAK), np.insert(near, gaps, -1)
        # of each character outside ASCII, where the stretch of such characters begins and ends
        at = np.arange(len(codes))
        begin = np.maximum.accumulate(np.where(odd, -1, at)) + 1
        end = np.minimum.accumulate(np.where(odd, len(codes), at)[::-1])[::-1]
        last_run: tuple[int, int, int] | None = None
        for first, last in max_scoring_segments(scores):  # pairs first..last-1
            b, e = int(near[first]), int(near[last - 1]) + 2
            if counts[e] == counts[b]:
                continue
            if odd[b] and odd[b - 1]:
                b = int(begin[b])
            if e < len(codes) and odd[e] and odd[e - 1]:
                e = int(end[e])
            number = int(np.searchsorted(starts, b + 1, side="right")) - 1
            b, e = max(b - int(starts[number]), 0), min(e - int(starts[number]), len(texts[number]))
            if last_run and last_run[0] == number and b <= last_run[2]:
                last_run = (number, last_run[1], max(e, last_run[2]))
                continue
            if last_run:
                yield last_run[0], last_run[1:]
            last_run = (number, b, e)
        if last_run:
            yield last_run[0], last_run[1:]

    def _choose(self, contexts: list[str], held: set[str]) -> tuple[list[_Reading | None], set[str]]:
        """The reading taken for each run of a text, if any, and the mappings that hold in the text.

        The text decides together: a mapping holds where the text as a whole gains enough by it, and by a table only if
        a whole word or more than one piece does. Of those the one by which all runs gain most is taken first, and then
        reads every run that it makes likelier; the next one is sought among the runs left.
        """
        readings = [self._remembered(c) for c in contexts]
        taken: list[_Reading | None] = [None] * len(contexts)
        left = [i for i, r in enumerate(readings) if r]
        held, tried = set(held), set()
        while left:
            total: dict[str, float] = {}
            likely: dict[str, float] = {}
            pieces: dict[str, set[str]] = {}
            for i in left:
                for r in readings[i]:
                    name = r.mapping.name
                    total[name] = total.get(name, 0.0) + r.gain
                    likely[name] = likely.get(name, 0.0) + (r.gain if r.likely or isinstance(r.mapping, _Table) else 0.0)
                    pieces.setdefault(name, set()).update(r.changed)
                    if r.likely and isinstance(r.mapping, _Table):
                        pieces[name] |= {"", r.new}
            sure = {m.name for m in self.utf8 if likely.get(m.name, 0.0) >= self.config.gain_utf8 or (m.name in held and m.name in total)}
            sure |= {m.name for m in self.tables if likely.get(m.name, 0.0) >= self.config.gain_text and len(pieces[m.name]) > 1}
            if not sure - tried:
                break
            # of equals the first listed, as more common ones are
            name = max((m.name for m in (*self.utf8, *self.tables) if m.name in sure - tried), key=total.get)
            tried.add(name)
            held.add(name)
            table = next((m for m in self.tables if m.name == name), None)
            for i, c in enumerate(contexts):
                if taken[i]:
                    continue
                if table is None:
                    taken[i] = next((r for r in readings[i] if r.mapping.name == name), None)
                elif table.pattern.search(c):  # weaker pieces too
                    new = self._restore(table, c, self.config.gain_weak)
                    taken[i] = _Reading(new, table, 0.0, False) if new != c else None
            left = [i for i in left if not taken[i]]
        return taken, held

    def repair(self, text: str | None, runs: list[tuple[int, int]] | None = None) -> tuple[bool, str | None, list[str], bool]:
        """(damaged, restored text, mappings that held, whether all damage could be restored).

        runs may give the text's improbable runs. Repeated until nothing changes: texts may have been garbled more than
        once. It ends, as every reading makes a text more probable.
        """
        if not text:
            return False, text, [], True
        runs = self.runs([text])[0] if runs is None else runs
        mappings: list[str] = []
        held: set[str] = set()
        while True:
            spans = self.quoted_spans(text) if runs else []
            runs = [(b, e) for b, e in runs if not self._only_quoted(text, b, e, spans)]
            edge = lambda i: text[i] if 0 <= i < len(text) else "\n"
            contexts = [edge(b - 1) + text[b:e] + edge(e) for b, e in runs]
            taken, held = self._choose(contexts, held)
            out, at = [], 0
            for (b, e), c, r in zip(runs, contexts, taken):
                if r and r.new[:1] == c[0] and r.new[-1:] == c[-1] and len(r.new) > 1:
                    out += [text[at:b], r.new[1:-1]]
                    at = e
                    mappings.append(r.mapping.name)
            if not out:
                break
            text = "".join(out) + text[at:]
            runs = self.runs([text])[0]
        lost = any("\ufffd" in text[b:e] for b, e in runs)
        # what a mapping of this text could read still, or a sequence cut short, is damage left
        left = any((m.cut and m.cut.search(c)) or self._restore(m, c, None) != c for m in self.utf8 if m.name in held for c in contexts)
        return bool(mappings) or lost, text, list(dict.fromkeys(mappings)), not (lost or left)

    def _only_quoted(self, text: str, b: int, e: int, spans) -> bool:
        """Whether all odd characters of the run lie in a quotation."""
        return bool(spans) and all(any(q <= i < r for q, r in spans) for i in range(b, e) if ord(text[i]) > 127)

    def quoted_spans(self, text: str) -> list[tuple[int, int]]:
        """Stretches that a lesson on encodings quotes on purpose.

        The text must put damaged characters into inline code and also have what a mapping makes of them, or, where
        they were lost, the same words with other characters in their places. Those stretches are all places where
        exactly the quoted characters stand.
        """
        if "`" not in text:
            return []
        spans = []
        quoted = {m.group(1) for m in _TICKED.finditer(_FENCE.sub("\n\n\n", text)) if any(ord(c) > 127 for c in m.group(1))}
        for q in sorted(quoted):
            if not self._shown_right(text, q):
                continue
            at = text.find(q)
            while at >= 0:
                spans.append((at, at + len(q)))
                at = text.find(q, at + len(q))
        return spans

    def _shown_right(self, text: str, quote: str) -> bool:
        if "\ufffd" in quote:
            parts = [re.escape(p) for p in re.split("\ufffd+", quote)]
            return sum(map(len, parts)) >= 3 and re.search("[^\ufffd\n]{1,6}".join(parts), text) is not None
        for m in (*self.utf8, *self.tables):
            right = m.pattern.sub(lambda p: m.read(p.group()), quote)  # noqa: B023
            if right != quote and right in text:
                return True
        return False


_FENCE = re.compile("```")
_TICKED = re.compile(r"`([^`\n]{1,200})`")


def repair_documents(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", config: RepairConfig = RepairConfig()) -> DataFrame:
    """Rows (id, damaged, restored_text, mappings, restorable) of the texts in which a stretch was read in a wrong encoding.

    Replacement characters mark damage that cannot be undone (restorable false); other damage in such a text is still
    restored. Null and empty texts, pure ASCII, characters quoted on purpose by a lesson, drawings and correct words
    of any language are not damaged. Repeated ids give a row each. Pair counts come from all texts.
    """
    counts = materialise(pair_counts(documents, text), "pair-counts").toPandas()  # at most 2**22 + 2**16 rows
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((counts.kind.to_numpy("int8"), counts.slot.to_numpy("int32"), counts.n.to_numpy("int64")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(PairModel(*shared.value), config)
        for b in batches:
            texts = b[text].tolist()
            rows = [(i, *repairer.repair(t, runs)) for i, t, runs in zip(b[id_col], texts, repairer.runs(texts)) if runs]
            rows = [r for r in rows if r[1]]
            if rows:
                yield pd.DataFrame(rows, columns=[id_col, "damaged", "restored_text", "mappings", "restorable"])

    id_type = documents.schema[id_col].dataType.simpleString()
    odd = documents.select(id_col, text).where(F.length(text) < F.octet_length(text))
    return odd.mapInPandas(work, f"{id_col} {id_type}, damaged boolean, restored_text string, mappings array<string>, restorable boolean")
