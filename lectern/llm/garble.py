"""Garbled text from wrong character encodings (problem 8).

A noisy channel: text written in encoding T was read in encoding W.  For every channel (W, T) the
stretches that W can have produced are turned back into bytes and these into a lattice: its arcs are
the characters of T that fit the bytes at a place, a lost byte fitting any, and the shown characters
themselves, changing between the two having its price.  The likeliest path under the corpus, by
characters and by word frequencies, is found by Viterbi search; what it is likelier than the text as
shown is the evidence.  A stretch without lost bytes has one reading, so its lattice has the two paths
"read" and "shown", which are compared without a search.

A replacement character, or a C1 control character, is all but impossible in sound text: each costs the
shown path ``BAD``.  Text read as UTF-8 by mistake has replacement characters only, one a byte that did
not fit; its lattices have one-byte encodings and GB 18030 as T, with as many lost bytes in a row as
there are.

The corpus model is a count sketch of characters, pairs, triples and words of all documents, of a
fixed size that does not grow with the data (two rows of 2 ** ``SKETCH_BITS`` counters, the median
counter, which is what collisions come to in a full sketch, being taken off): each task counts its
rows into arrays, the arrays are summed by counter, and the sums are broadcast.  Words are weighed by
their share of all words, those under ``RARE`` alike, so that a document is judged alike in a corpus of
any size.

Channels into UTF-8 look for byte sequences that are valid UTF-8.  Channels between one-byte encodings
are tried word by word, channels into two-byte encodings stretch by stretch.  A document is affected if
the evidence of its best channel and of its bad characters reaches the threshold.

Nulls: null and empty texts are not affected; a null id is kept.  Repeated rows count once in the
result of ``garbled``.  Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import emit, small_batches
from lectern.session import spread, table

#: Counters in a row of the sketch (a power of two).
SKETCH_BITS = 20
#: The gain that a channel needs in a document: into UTF-8, whose form is nearly proof in itself,
#: into two-byte encodings, whose stretches seldom fit by chance, and between one-byte encodings.
EVIDENCE_UTF8, EVIDENCE_WIDE, EVIDENCE = 0.5, 3.5, 7.0
#: The least gain of one word that counts as evidence, and the log-likelihood of a character
#: given those before it, below which a word is looked into.
LEAST, UNUSUAL = 2.0, -3.5
#: What a change between sound and garbled text costs in a lattice, and a bad character in sound text.
SWITCH, BAD = 6.0, 20.0
#: What a change of case inside a word costs where a lost character is chosen.
CAPITAL = 3.0
#: States that a place of a lattice keeps, 0 for all (exact, and slow where many bytes are lost).
BEAM = 16
#: Signs beside bad characters that belong to their lattice.
AROUND = 12
#: The share of all words below which words count alike.
RARE = 1e-6

# Encodings by their Python names, those with one byte a character first.
ONE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp866", "iso8859-5", "iso8859-15", "cp1254")
MANY_BYTE = ("gb18030", "cp932", "cp950", "euc_kr")
# True encodings of one-byte channels by script, as (read in, written in).
ONE_BYTE_PAIRS = tuple((w, t) for w in ONE_BYTE for t in ("cp1252", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "iso8859-5", "cp1250") if w != t)
TWO_BYTE_PAIRS = tuple((w, t) for w in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437") for t in ("gb18030", "cp932", "cp950"))

_UTF8_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){3,}")
_TOKEN = re.compile(r"[^\s\x00-\x26\x28-\x3e\x40\x5b-\x60\x7b-\x7f]+")
_HIGH_TOKEN = re.compile(r"[A-Za-z'?]*[^\s\x00-\x7f]" + _TOKEN.pattern[:-1] + "*")
_WORDS = re.compile(r"[^\W\d_㐀-鿿]+")
_WIDE = re.compile("[\u2e80-\ufaff\uff61-\uff9f]")
_WORD_BEFORE, _WORD_AFTER = re.compile(r"[^\W\d_]*\Z"), re.compile(r"[^\W\d_]{0,40}")
_UNFIT = re.compile("[\\x00\x80-\x9f]")
_HIGH = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_LETTERS = re.compile(r"[^\W\d_]")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_NARROW = re.compile("[^\\x00-\x7f\u2e80-\uffef]{4,}")
_LOST = "�"
_BAD = re.compile("[\x80-\x84\x86-\x9f�]")
_WHOLE_BAD = re.compile("[^\\x00-\x7f]*[\x80-\x84\x86-\x9f�](?:[^\\x00-\x7f]|[@-~](?=[^\\x00-\x7f]))*")
_AROUND_BAD = re.compile(f"[^\\x00-\x7f]{{0,{AROUND}}}[\x80-\x84\x86-\x9f�](?:[^\\x00-\x7f]|[@-~](?=[^\\x00-\x7f])){{0,{AROUND}}}")
_KEYS = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]], np.uint64)


def _mix(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _KEYS[row, 0]
    return (values ^ (values >> np.uint64(29))) * _KEYS[row, 1] >> np.uint64(64 - bits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _word_code(word: str) -> int:
    code = 0xCBF29CE484222325
    for byte in word.encode("utf-8", "surrogatepass"):
        code = (code ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return code


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of the characters, pairs and triples that end at each position from the third."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    return c | np.uint64(1 << 63), (b << np.uint64(21)) | c | np.uint64(1 << 62), (a << np.uint64(42)) | (b << np.uint64(21)) | c


def _folded(text: str) -> str:
    return "  " + " ".join(text.lower().split()) + " "


def _count_text(texts: list[str], bits: int, into: np.ndarray) -> None:
    words: Counter = Counter()
    for text in texts:
        lowered = _folded(text)
        one, two, three = _features(_codes(lowered))
        for row in range(2):
            for names in (one, two, three):
                into[row] += np.bincount(_mix(names, row, bits).astype(np.int64), minlength=1 << bits)
        words.update(_WORDS.findall(lowered))
    if words:
        names = np.array([_word_code(w) for w in words], np.uint64)
        counts = np.array(list(words.values()), np.int64)
        for row in range(2):
            np.add.at(into[row], _mix(names, row, bits).astype(np.int64), counts)
    into[2, 0] += sum(words.values())
    into[2, 1] += sum(map(len, texts))


def corpus_sketch(texts: DataFrame, column: str = "text", bits: int = SKETCH_BITS) -> np.ndarray:
    """The count sketch of ``texts[column]``: array (3, 2 ** bits); row 2 holds the totals.

    Sums over all rows; what reaches the driver has one row per counter at most, whatever the data."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros((3, 1 << bits), np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                    if size > 1_600_000:  # one long string is counted much faster than many short ones
                        _count_text(["\n".join(held)], bits, sums)
                        held, size = [], 0
        if held:
            _count_text(["\n".join(held)], bits, sums)
        at = np.flatnonzero(sums)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums.reshape(-1)[part])], names=["at", "n"])

    # A task's sums may have a row per counter, so a sketch is made per core rather than per split.
    held, most = texts.select(column), 2 * texts.sparkSession.sparkContext.defaultParallelism
    rows = (held.coalesce(most) if held.rdd.getNumPartitions() > most else held).mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(3 << bits, np.int64)
    sketch[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return sketch.reshape(3, 1 << bits)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``part / whole``; nothing where the part exceeds the whole, for then the count is a collision."""
    return np.where(part <= whole, part / (whole + 2.0), 0.0)


class Model:
    """Log-likelihoods under a corpus sketch."""

    def __init__(self, sketch: np.ndarray):
        self.bits = sketch.shape[1].bit_length() - 1
        # Half of the counters hold no more than collisions once the sketch is full.
        self.rows = np.maximum(sketch[:2] - np.median(sketch[:2], axis=1).astype(np.int64)[:, None], 0)
        self.words, self.characters = int(sketch[2, 0]) + 1, int(sketch[2, 1]) + 1
        self.score = lru_cache(200_000)(self._score)
        self.alphabet = lru_cache(None)(self._alphabet)
        self.has = lru_cache(None)(lambda sign: bool(self.counts(np.array([ord(sign.lower()[:1])], np.uint64) | np.uint64(1 << 63))[0]))

    def counts(self, names: np.ndarray) -> np.ndarray:
        return np.minimum(*(self.rows[r][_mix(names, r, self.bits).astype(np.int64)] for r in range(2)))

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """The log-likelihood of each character from the third on, given the two before it."""
        one, two, three = _features(codes)
        first = codes[1:2] | np.uint64(1 << 63)
        pair = (codes[:1] << np.uint64(21)) | codes[1:2] | np.uint64(1 << 62)
        n = len(one)
        counted = self.counts(np.concatenate([first, one, pair, two, three]))
        singles, pairs, c3 = counted[: n + 1], counted[n + 1 : 2 * n + 2], counted[2 * n + 2 :]
        p = 0.7 * _share(c3, pairs[:-1]) + 0.25 * _share(pairs[1:], singles[:-1])
        return np.log(p + 0.05 * (singles[1:] + 0.01) / self.characters)

    def conditional(self, lasts: np.ndarray, signs: "Signs") -> np.ndarray:
        """The log-likelihoods of ``signs`` (columns) after each pair of characters (rows of ``lasts``)."""
        a, b, c = lasts[:, :1], lasts[:, 1:], signs.codes[None, :]
        one, two, s = np.uint64(1 << 63), np.uint64(1 << 62), np.uint64(21)
        c3, c2 = self.counts((a << np.uint64(42)) | (b << s) | c), self.counts((b << s) | c | two)
        b2, b1 = self.counts((a << s) | b | two), self.counts(b | one)
        if signs.single is None:
            signs.single = self.counts(c | one)
        p = 0.7 * _share(c3, b2) + 0.25 * _share(c2, b1)
        return np.log(p + 0.05 * (signs.single + 0.01) / self.characters)

    def _score(self, text: str) -> float:
        """The log-likelihood of ``text`` with its first two characters given."""
        return float(self.steps(_codes(text.lower())).sum()) if len(text) > 2 else 0.0

    def scores(self, words: list[str]) -> list[float]:
        """The log-likelihood of each word between spaces, in one pass."""
        parts = [f"  {w} ".lower() for w in words]
        steps = self.steps(_codes("".join(parts)))
        ends = np.cumsum([len(p) for p in parts])
        sums = np.concatenate([[0.0], np.cumsum(steps)])
        return [float(sums[end - 2] - sums[end - len(p)]) for p, end in zip(parts, ends)]

    def frequencies(self, texts: list[str]) -> np.ndarray:
        """The mean log-share, of all words of the corpus, of each text's words of three letters and more."""
        words = [[w for w in _WORDS.findall(t.lower()) if len(w) > 2] for t in texts]
        names = np.array([_word_code(w) for part in words for w in part], np.uint64)
        logs = np.log(self.counts(names) / self.words + RARE) if len(names) else np.zeros(0)
        ends = np.cumsum([len(part) for part in words])
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        sizes = np.array([len(part) for part in words])
        return np.where(sizes > 0, (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1), np.log(RARE))

    def _alphabet(self, written: str) -> dict[int, tuple[np.ndarray, "Signs"]]:
        """The corpus's characters beyond ASCII that ``written`` has, by length in bytes: (bytes, characters)."""
        codes = np.concatenate([np.arange(0xA0, 0xD800), np.arange(0xF900, 0xFFF0), np.arange(0x1F300, 0x1FB00), np.arange(0x20000, 0x2A6E0)]).astype(np.uint64)
        found: dict[int, tuple[list[bytes], list[str]]] = {}
        for sign in map(chr, codes[self.counts(codes | np.uint64(1 << 63)) > 0].tolist()):
            for form in {sign, sign.upper()}:
                try:
                    data = form.encode(written)
                except UnicodeEncodeError:
                    continue
                if len(form) == 1:
                    rows = found.setdefault(len(data), ([], []))
                    rows[0].append(data)
                    rows[1].append(form)
        return {n: (np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n), Signs(signs)) for n, (rows, signs) in found.items()}


@lru_cache(None)
def _to_byte(encoding: str) -> dict[int, str]:
    """Characters of a one-byte encoding to bytes, written as the characters U+0080 to U+00FF."""
    out = {}
    for byte in range(128, 256):
        try:
            out[ord(bytes([byte]).decode(encoding))] = chr(byte)
        except UnicodeDecodeError:
            # A byte without a character often passes as the control character of its number.
            out.setdefault(byte, chr(byte))
    return out


@lru_cache(None)
def _from_byte(encoding: str) -> dict[int, str]:
    out = {}
    for byte in range(128, 256):
        try:
            out[byte] = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def _table(read: str, written: str) -> dict[int, str]:
    """Translates text of a one-byte channel; characters that W lacks are left, as U+0000 if high."""
    back = _from_byte(written)
    return {shown: back.get(ord(byte), "\0") for shown, byte in _to_byte(read).items()}


@lru_cache(None)
def _known(encoding: str) -> frozenset[str]:
    return frozenset(map(chr, _to_byte(encoding)))


class _Bytes(dict):
    """Characters to the bytes of a many-byte encoding, filled as they occur; b'' if it has none."""

    def __init__(self, encoding: str):
        self.encoding = encoding

    def __missing__(self, sign: str) -> bytes:
        try:
            value = sign.encode(self.encoding)
        except UnicodeEncodeError:
            value = b""
        self[sign] = value
        return value


_MANY = {w: _Bytes(w) for w in MANY_BYTE}


def _fits(model: Model, text: str, start: int, end: int, readings: list[str]) -> np.ndarray:
    """The log-likelihoods of ``readings`` in place of ``text[start:end]``: characters, with their neighbours,
    and the words they make with the letters beside them, less what bad characters cost."""
    left, right = ("  " + text[max(0, start - 2) : start])[-2:], (text[end : end + 2] + "  ")[:2]
    word, rest = _WORD_BEFORE.search(text, max(0, start - 40), start).group(), _WORD_AFTER.match(text, end).group()
    signs = np.array([model.score(left + x + right) - BAD * len(_BAD.findall(x)) for x in readings])
    return np.round(signs + model.frequencies([word + x + rest for x in readings]), 6)


def _gains(model: Model, text: str, changes: list[tuple[int, int, str]]) -> list[float]:
    """By how much each (start, end, reading) is likelier than what is shown: the two paths of a lattice of one
    reading, as ``_fits`` has them, all in one pass."""
    lines, words = [], []
    for start, end, new in changes:
        left, right = ("  " + text[max(0, start - 2) : start])[-2:], (text[end : end + 2] + "  ")[:2]
        word, rest = _WORD_BEFORE.search(text, max(0, start - 40), start).group(), _WORD_AFTER.match(text, end).group()
        for x in (new, text[start:end]):
            lines.append((left + x + right).lower())
            words.append(word + x + rest)
    steps = model.steps(_codes("".join(lines)))
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    sums = np.concatenate([[0.0], np.cumsum(steps)])
    fits = sums[ends - 2] - sums[ends - sizes] + model.frequencies(words)
    # Two signs make a character of UTF-8 too easily; one that the corpus does not have proves nothing.
    bad = np.array([BAD * (len(_BAD.findall(text, start, end)) - len(_BAD.findall(new)) - sum(not model.has(x) for x in new if x < "\u0800")) for start, end, new in changes])
    return (fits[0::2] - fits[1::2] + bad).tolist()


@lru_cache(None)
def _utf8_shown(read: str) -> re.Pattern:
    """The stretches of text that are UTF-8 sequences shown in the one-byte encoding ``read``."""
    shown = {ord(byte): chr(sign) for sign, byte in _to_byte(read).items()}

    def signs(low: int, high: int) -> str:
        return "[" + "".join(re.escape(shown[b]) for b in range(low, high + 1) if b in shown) + "]"

    rest = signs(0x80, 0xBF)
    return re.compile(f"(?:{signs(0xC2, 0xDF)}{rest}|{signs(0xE0, 0xEF)}{rest}{{2}}|{signs(0xF0, 0xF4)}{rest}{{3}})+")


@lru_cache(None)
def _leads_and_rest(read: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters that show UTF-8's first and later bytes in ``read``."""
    signs = _to_byte(read).items()
    return frozenset(chr(c) for c, b in signs if "\xc2" <= b <= "\xf4"), frozenset(chr(c) for c, b in signs if b < "\xc0")


def _utf8_stretches(text: str, model: Model) -> dict[str, list[tuple[int, int, str, float]]]:
    """For each W, the stretches (start, end, reading, gain) that are UTF-8 read in W."""
    found: dict[str, list] = {}
    near = set("".join(_RUN.findall(text)))  # a sequence is two high signs at least
    for read in ONE_BYTE:
        leads, rest = _leads_and_rest(read)
        if not (near & leads and near & rest):
            continue
        spans = []
        for match in _utf8_shown(read).finditer(text):
            try:
                new = match.group().translate(_to_byte(read)).encode("latin-1").decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            # Sound words show two signs that read as one all the time, but hardly ever one that the corpus has.
            if all(model.has(x) for x in new if x < "\u0800"):
                spans.append((match.start(), match.end(), new))
        if spans:
            found[read] = [(*x, gain) for x, gain in zip(spans, _gains(model, text, spans))]
    if _WIDE.search(text):
        for read in MANY_BYTE:
            # One pass in C finds out whether there is anything to look at.
            if not _UTF8_BYTES.search(text.encode(read, "replace")):
                continue
            spans = []
            for run in _RUN.finditer(text):
                spans += [x for x in _many_byte_spans(text, run.start(), run.end(), read) if all(model.has(c) for c in x[2] if c < "\u0800")]
            if spans:
                found[read] = [(*x, gain) for x, gain in zip(spans, _gains(model, text, spans))]
    return found


def _many_byte_spans(text: str, start: int, end: int, read: str) -> list[tuple[int, int, str]]:
    table, at, parts = _MANY[read], [], []
    for k in range(start, end):
        parts.append((text[k] != _LOST and table[text[k]]) or b"\xff")
        at += [k] * len(parts[-1])
    joined, out = b"".join(parts), []
    for match in _UTF8_BYTES.finditer(joined):
        first, last = match.start(), match.end()
        # Whole characters of W only, and of those whole characters of UTF-8.
        while first and first < last and (at[first] == at[first - 1] or joined[first] & 0xC0 == 0x80):
            first += 1
        while last < len(joined) and last > first and (at[last] == at[last - 1] or joined[last] & 0xC0 == 0x80):
            last -= 1
        new = joined[first:last].decode("utf-8", "replace")
        if last - first < 6 or _LOST in new:
            continue
        begin, stop = at[first], at[last - 1] + 1
        out.append((begin, stop, new))
    return out


def _one_byte_tokens(text: str, model: Model, cache: dict) -> dict[tuple[str, str], list[tuple[str, str, float]]]:
    """For each one-byte channel, the (word, reading, gain) of the words that it improves."""
    found = defaultdict(list)
    for token in set(_HIGH_TOKEN.findall(text)):
        if token not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[token] = () if _WIDE.search(token) else _readings(token, model)
        for channel, new, gain in cache[token]:
            found[channel].append((token, new, gain))
    return found


def _readings(token: str, model: Model) -> list[tuple[tuple[str, str], str, float]]:
    padded = f"  {token} "
    steps = model.steps(_codes(padded.lower()))
    # A garbled word has characters that the corpus seldom has there; most words end here.
    if steps.min() > UNUSUAL:
        return []
    high = {c for c in token if c > "\x7f"}
    channels = {}
    for read, written in ONE_BYTE_PAIRS:
        if high <= _known(read):
            new = token.translate(_table(read, written))
            if new != token and not _UNFIT.search(new):
                channels[read, written] = new
    if not channels:
        return []
    news = sorted(set(channels.values()))
    often = model.frequencies([token, *news])
    old = float(steps.sum()) + often[0]
    gains = {new: float(score + much - old) for new, score, much in zip(news, model.scores(news), often[1:])}
    return [(channel, new, gains[new]) for channel, new in channels.items() if gains[new] >= LEAST]


def _two_byte_runs(text: str, model: Model, cache: dict) -> dict[tuple[str, str], list[tuple[int, int, str, float]]]:
    found = defaultdict(list)
    for run in _NARROW.finditer(text):
        shown = run.group()
        if (key := ("run", shown)) not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[key] = _wide_readings(shown, model)
        for channel, new, gain in cache[key]:
            found[channel].append((run.start(), run.end(), new, gain))
    return found


def _wide_readings(shown: str, model: Model) -> list[tuple[tuple[str, str], str, float]]:
    """The readings of a stretch of narrow signs in two-byte encodings; an odd last sign stays."""
    out, held = [], set(shown)
    old = model.score(f"  {shown}  ") + model.frequencies([shown])[0]
    for read, written in TWO_BYTE_PAIRS:
        if not held <= _known(read):
            continue
        data, new = shown.translate(_to_byte(read)).encode("latin-1"), ""
        for end, rest in ((len(data), ""), (len(data) - 1, shown[-1])):
            try:
                new = data[:end].decode(written) + rest
                break
            except UnicodeDecodeError:
                continue
        if sum("⺀" <= c < "｠" for c in new) * 2 > len(new):
            gain = float(model.score(f"  {new}  ") + model.frequencies([new])[0] - old) - BAD * sum(not model.has(x) for x in new)
            if gain > LEAST:
                out.append(((read, written), new, gain))
    return out


def diagnose(text: str, model: Model, cache: dict) -> tuple[str | None, float, list]:
    """(channel, evidence, changes) of a text; no channel if it looks sound.

    Changes are (start, end, reading) for channels that work on stretches, (word, reading) else.  Bad
    characters are looked at only where the channels' own evidence does not suffice."""
    if not text or not _HIGH.search(text):
        return None, 0.0, []
    best: tuple[str | None, float, list] = (None, 0.0, [])
    for read, spans in _utf8_stretches(text, model).items():
        # Weighed so that channels of all sorts compare by what they exceed their thresholds.
        gain = sum(g for *_, g in spans if g > 0) * EVIDENCE / EVIDENCE_UTF8
        if gain > best[1]:
            best = (f"{read}<utf-8", gain, [(s, e, new) for s, e, new, g in spans if g > 0])
    for (read, written), words in _one_byte_tokens(text, model, cache).items():
        # Signs and single letters follow the words of a channel but prove nothing themselves.
        gain = sum(g for old, new, g in words if len(_LETTERS.findall(new)) > 2)
        if gain > best[1]:
            best = (f"{read}<{written}", gain, [(old, new) for old, new, _ in words])
    for (read, written), spans in _two_byte_runs(text, model, cache).items():
        gain = sum(g for *_, g in spans) * EVIDENCE / EVIDENCE_WIDE
        if gain > best[1]:
            best = (f"{read}<{written}", gain, [(s, e, new) for s, e, new, _ in spans])
    if best[1] >= EVIDENCE:
        return best
    lost = best[1]
    for *_, gain in _bad_stretches(text, (best[0] or "").split("<")[0], model, EVIDENCE):
        lost += gain
        if lost >= EVIDENCE:
            return (best[0] or "lost"), lost, best[2]
    return None, best[1], []


class Signs:
    """Characters that an arc may have, with what is asked of them again and again."""

    def __init__(self, signs: list[str]):
        self.signs, self.codes, self.single = signs, np.array([ord(x.lower()[:1]) for x in signs], np.uint64), None
        self.upper, self.lower = np.array([[x.isupper() for x in signs]]), np.array([[x.islower() for x in signs]])


@lru_cache(100_000)
def _sign(sign: str) -> Signs:
    return Signs([sign])


def _candidates(items: list[int], at: int, written: str, model: Model) -> Iterator[tuple[int, Signs]]:
    """(next place, characters): what of ``written`` may begin at ``at``; -1 is a lost byte, which fits any.

    Known bytes are decoded; where bytes are lost, the characters are those that the corpus has."""
    if 0 <= items[at] < 0x80:
        yield at + 1, _sign(chr(items[at]))
        return
    for length in (1, 2, 3, 4):
        part = items[at : at + length]
        if len(part) < length:
            return
        if -1 not in part:
            try:
                sign = bytes(part).decode(written)
            except (UnicodeDecodeError, ValueError):
                continue
            if len(sign) == 1:
                yield at + length, _sign(sign)
        elif length in (held := model.alphabet(written)):
            rows, signs = held[length]
            if part == [-1] * length:
                yield at + length, signs
                continue
            fits = np.ones(len(rows), bool)
            for k, byte in enumerate(part):
                if byte != -1:
                    fits &= rows[:, k] == byte
            if fits.any():
                yield at + length, Signs([signs.signs[k] for k in np.flatnonzero(fits)])


def viterbi(items: list[int], literal: dict[int, tuple[int, str]], left: str, model: Model, written: str = "utf-8", beam: int | None = None) -> list[str]:
    """The likeliest readings of bytes, -1 for a lost one, after the text ``left``; best first.

    Arcs are the characters of ``written`` that fit the bytes and the shown characters themselves
    (``literal``: place to next place and character); changing between the two costs ``SWITCH``, a shown
    character that is bad ``BAD``.  A state is the last two characters and the kind of the last arc; each
    place keeps the ``beam`` likeliest (``BEAM`` if None, all if 0)."""
    keep = BEAM if beam is None else beam
    states: dict[int, dict[tuple[str, bool], tuple[float, tuple]]] = {0: {(("  " + left)[-2:], False): (0.0, ())}}
    for at in range(len(items)):
        here = sorted(states.pop(at, {}).items(), key=lambda x: -x[1][0])[: keep or None]
        if not here:
            continue
        lasts = np.array([[ord(c) for c in last.lower()[:2]] for (last, _), _ in here], np.uint64)
        scores, modes = np.array([x[1][0] for x in here]), np.array([mode for (_, mode), _ in here])
        arcs = [(after, signs, True) for after, signs in _candidates(items, at, written, model)]
        if at in literal:
            arcs.append((literal[at][0], _sign(literal[at][1]), False))
        for after, signs, read in arcs:
            total = model.conditional(lasts, signs) + (scores - SWITCH * (modes != read))[:, None]
            if len(signs.signs) > 1:  # the model knows no case: a capital in a word begins it or follows capitals
                small, large = (np.array([f(last) for (last, _), _ in here])[:, None] for f in (lambda x: x[1].islower(), lambda x: x[0].isupper() and x[1].isupper()))
                total = total - CAPITAL * ((small & signs.upper) | (large & signs.lower))
            elif not read and _BAD.match(signs.signs[0]):
                total = total - BAD
            width, total = len(signs.signs), total.ravel()
            best = np.argpartition(-total, 2 * keep)[: 2 * keep] if keep and len(total) > 2 * keep else np.arange(len(total))
            slot = states.setdefault(after, {})
            for k in best.tolist():
                (last, _), (_, said) = here[k // width]
                sign, value = signs.signs[k % width], float(total[k])
                key = ((last + sign)[-2:], read)
                if key not in slot or slot[key][0] < value:
                    slot[key] = (value, (said, sign))
    readings = []
    for _, said in sorted(states.get(len(items), {}).values(), key=lambda x: -x[0])[: keep or None]:
        out = []
        while said:
            said, sign = said
            out.append(sign)
        readings.append("".join(reversed(out)))
    return readings


def _lattice(run: str, read: str) -> tuple[list[int], dict[int, tuple[int, str]]]:
    """The bytes of a stretch shown in ``read``, -1 for a lost one, and its shown characters by place."""
    items: list[int] = []
    literal: dict[int, tuple[int, str]] = {}
    for sign in run:
        at = len(items)
        if sign == _LOST:
            items.append(-1)
        elif sign < "\x80" or read == "utf-8":
            items += sign.encode("utf-8", "surrogatepass")
        elif read in ONE_BYTE:
            byte = _to_byte(read).get(ord(sign))
            items.append(ord(byte) if byte else 0x1FF)  # a character that W lacks stands for itself only
        else:
            items += list(_MANY[read][sign]) or [0x1FF]
        literal[at] = (len(items), sign)
    return items, literal


# Fixed values: (read in, written in) of the lattices that are tried for every bad character.
BAD_CHANNELS = {_LOST: (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "gb18030")), "\x80": (("latin-1", "cp1252"), ("latin-1", "utf-8"), ("latin-1", "cp1251"), ("latin-1", "gb18030"))}


def _bad_channels(old: str, read: str) -> list[tuple[str, str]]:
    """The channels that are tried for a stretch with bad characters; ``read`` is the document's, if known."""
    channels = [(read, "utf-8")] if read in ONE_BYTE or read in MANY_BYTE else []
    channels += BAD_CHANNELS[_LOST if _LOST in old else "\x80"]
    return channels + [(w, "utf-8") for w in MANY_BYTE if w != read and _WIDE.search(old)]


def _bad_stretches(text: str, read: str, model: Model, enough: float = float("inf")) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, reading, gain) of the stretches around bad characters, by the channel whose path is likeliest
    (the first whose gain is ``enough``); the reading is the shown text where no path is likelier, its bad
    characters then being the gain: whatever they were, they were not these."""
    for run in _AROUND_BAD.finditer(text):
        start, end, new, gain, _ = _best_path(text, run.start(), run.end(), _bad_channels(run.group(), read), model, enough)
        yield start, end, new, gain


def _best_path(text: str, start: int, end: int, channels: list[tuple[str, str]], model: Model, enough: float = float("inf")) -> tuple[int, int, str, float, tuple[str, str] | None]:
    """(start, end, reading, gain, channel) of the likeliest path of a stretch over all ``channels``."""
    old, left = text[start:end], text[max(0, start - 2) : start]
    best = (start, end, old, BAD * len(_BAD.findall(old)), None)
    found = 0.0
    for w, t in channels:
        items, literal = _lattice(old, w)
        readings = [x for x in viterbi(items, literal, left, model, t) if x != old]
        if not readings:
            continue
        fits = _fits(model, text, start, end, [old, *readings])
        place = int(np.argmax(fits[1:]))
        gain = float(fits[place + 1] - fits[0])
        if gain > found:
            found, best = gain, (start, end, readings[place], gain, (w, t))
        if gain >= enough:
            break
    return best


def _mended(text: str, read: str, model: Model) -> str:
    """``text`` with its runs of bad and other high characters read by the channel that fits best around the first
    bad one of each."""
    out, done = [], 0
    for run in _WHOLE_BAD.finditer(text):
        near = _AROUND_BAD.search(text, run.start(), run.end())
        channel = _best_path(text, near.start(), near.end(), _bad_channels(near.group(), read), model)[4]
        if channel:
            new = _best_path(text, run.start(), run.end(), [channel], model)[2]
            out += [text[done : run.start()], new]
            done = run.end()
    return "".join(out) + text[done:]


def restore(text: str, channel: str, changes: list, model: Model, cache: dict) -> str:
    """``text`` as far as it can be restored; a text garbled several times over takes as many rounds.

    Each round makes the text likelier by the evidence it takes; one that comes back to a text ends them."""
    seen: set[str] = set()
    while text not in seen:
        seen.add(text)
        if changes and len(changes[0]) == 3:
            out, done = [], 0
            for start, end, new in sorted(changes):
                if start >= done:
                    out += [text[done:start], new]
                    done = end
            text = "".join(out) + text[done:]
        elif changes:
            readings = dict(changes)
            text = _TOKEN.sub(lambda m: readings.get(m.group(), m.group()), text)
        if _BAD.search(text):
            text = _mended(text, channel.split("<")[0], model)
        channel, evidence, changes = diagnose(text, model, cache)
        if not channel or not changes or evidence < EVIDENCE:
            break
    return text


_RESULT = pa.schema([("doc_id", pa.int64()), ("channel", pa.string()), ("evidence", pa.float64()), ("text", pa.string())])


def garbled(documents: DataFrame, restored: bool = True, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, channel, evidence, text) of the affected rows of ``documents(doc_id, text)``.

    ``channel`` is "read in<written in", or "lost" where bytes are lost and no channel explains the
    rest; ``text`` is restored as far as possible, or null if not ``restored``."""
    spark = documents.sparkSession
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shared = spark.sparkContext.broadcast(corpus_sketch(rows, "text", bits))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Model(shared.value), {}

        def out():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    channel, evidence, changes = diagnose(text or "", model, cache)
                    if channel:
                        yield doc, channel, evidence, restore(text, channel, changes, model, cache) if restored else None

        return emit(out(), _RESULT)

    return rows.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInArrow(find, "doc_id bigint, channel string, evidence double, text string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents"), restored=False).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, channel, text): the affected documents and their text as far as restored."""
    return garbled(table(spark, sf_dir, "documents")).select("doc_id", "channel", "text")


QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
ORACLE: dict[str, str] = {}
