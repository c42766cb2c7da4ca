"""Defective question-answer pairs and their defects (problem 2).

Refusals are found by what recurs, not by a list of phrases.  Every sentence of every answer gives
its opening.  Equal openings are counted together; near-equal ones are grouped by MinHash over
character triples, a proposed pair counting only if its Jaccard similarity is verified.  A group is a
template if it recurs across unrelated questions, those that are near-equal counting about once; a
template is a refusal if its answers were recorded as refused much more often than answers are in
general: the log-likelihood ratio of its count of refused answers (``REFUSED_SHARE`` against the overall
share) must exceed ``EVIDENCE``.  An answer refuses if all its sentences open like refusals.

The other defects are tests of one pair: copies by comparing letters and digits, language by profiles
learnt from the pairs (``language``), of the answer without its quotations, truncation by the end of the
last line.  Where a last line has no closing mark and may still be whole (lists and short answers), its last
two or three words must end a sentence or a short answer in other answers, in at least ``ENDS_SHARE``
of all the answers that have them, those with the words inside a sentence included.

Nulls: a null answer is ``empty``; a null or blank question gives no copy and no other language.
Only rows with status succeeded or refused are pairs.  Repeated rows and earlier states count once,
by ``valid_turns``.  Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.batches import emit, small_batches
from lectern.llm.language import differing, profiles
from lectern.llm.language import seed as language
from lectern.llm.turns import valid_turns
from lectern.operators.similarity import minhash_groups
from lectern.session import broadcast_small, cut, spread, table

#: Unrelated questions a template must recur in, its expected share of refused answers, and the evidence needed.
QUESTIONS, REFUSED_SHARE, EVIDENCE = 3, 0.5, 3.0
#: The share of the other answers with the same words that must have them at an end, for an unmarked
#: end to count as one.  Cuts fall on any word alike, so even phrases that often precede a cut stay far below.
ENDS_SHARE = 0.01
#: Cells by which the words looked for are sifted before they are joined.
TAIL_CELLS = 1 << 20

_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+(?:['’][^\W_㐀-鿿]+)*")
_NO_LETTERS = re.compile(r"[\W_]+")
_CITATION = re.compile(r"\s*\[\^?[\w-]{1,12}\]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*|[\r\n]+")
_MARKER = re.compile(r"^\s*(?:>\s*)*(?:[-*•]\s+|\d{1,3}[.)]\s*|#{1,6}\s+)*")
_LISTED = re.compile(r"^\s*(?:[-*•]\s|\d{1,3}[.)](?:\s|$))")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|《[^》]*》|\"[^\"\n]*\"")
_CLOSED = re.compile(r"[.!?。！？…][\"'”’»“)\]）」』]*$|[”»」』\]）)]$")
_PAIRS = (("«", "»"), ("《", "》"), ("「", "」"), ("（", "）"), ("(", ")"), ("[", "]"))

# Names of the languages, in several of them, as a question may ask for one.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английск 英语 英文",
    "zh": "chinese chinesisch chinois chino китайск 中文 汉语 chinesischer",
    "fr": "french französisch français francés французск 法语 法文",
    "de": "german deutsch allemand alemán немецк 德语 德文",
    "es": "spanish spanisch espagnol español испанск 西班牙语 西班牙文",
    "ru": "russian russisch russe ruso русск 俄语 俄文",
}
_ASKED = [(code, re.compile("|".join(re.escape(n) for n in names.split()))) for code, names in LANGUAGE_NAMES.items()]


def _plain(text: str) -> str:
    return _NO_LETTERS.sub("", unicodedata.normalize("NFKC", text).lower())


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer's letters and digits are the question's, repeated or in part, or besides
    them no more than a label of two words."""
    asked, said = _plain(question), _plain(_CITATION.sub("", answer))
    if not asked or not said:
        return False
    if asked in said:
        rest = [w for w in _WORD.findall(unicodedata.normalize("NFKC", _CITATION.sub("", answer)).lower()) if not re.fullmatch(r"[㐀-鿿]", w)]
        extra = said.replace(asked, "")
        if not extra:
            return True
        if re.search(r"[㐀-鿿]", extra):
            return len(extra) <= 4
        own = set(_WORD.findall(unicodedata.normalize("NFKC", question).lower()))
        return len(extra) <= 16 and sum(w not in own for w in rest) <= 2
    return 2 * len(said) >= len(asked) and (said in asked)


def unquoted_lines(text: str) -> str:
    return "\n".join(x for x in re.split(r"[\r\n]+", text) if not x.lstrip().startswith(">"))


def proper(text: str) -> str:
    """``text`` without quoted lines and quotations, or with them where nothing else is left."""
    lines = unquoted_lines(text)
    bare = _QUOTED.sub(" ", lines)
    return bare if re.search(r"[^\W\d_]{2}", bare) else lines


def speak_otherwise(table: np.ndarray, questions: list[str], answers: list[str]) -> list[bool]:
    """Whether each answer proper is in another language than its question, which did not ask for it."""
    said = differing(table, [proper(q) for q in questions], [proper(a) for a in answers], [unquoted_lines(a) for a in answers])
    return [bool(code) and not any(code == c and names.search(q.lower()) for c, names in _ASKED) for code, q in zip(said, questions)]


def sentences(answer: str) -> list[str]:
    """The sentences and lines of an answer that have letters, without markers and citations."""
    parts = (_MARKER.sub("", x).strip() for x in _SENTENCE.split(_CITATION.sub("", answer)))
    return [x for x in parts if re.search(r"[^\W\d_]", x)]


def opening(sentence: str) -> str:
    """The first five words, or eight wide characters, in lower case."""
    words = _WORD.findall(unicodedata.normalize("NFKC", sentence).lower())
    wide = sum(len(w) == 1 and "㐀" <= w <= "鿿" for w in words[:8])
    return "".join(words[:8]) if 2 * wide > len(words[:8]) else " ".join(words[:5])


def _counted(text: str) -> list[str]:
    return ["#" if w.isdigit() else w for w in _WORD.findall(unicodedata.normalize("NFKC", text).lower())]


def _last(words: list[str], end: int) -> list[str]:
    wide = end > 0 and "㐀" <= words[end - 1] <= "鿿"
    glue, long, brief = ("", 6, 4) if wide else (" ", 3, 2)
    return [glue.join(words[max(0, end - long) : end]), glue.join(words[max(0, end - brief) : end])]


def tails(text: str) -> list[str]:
    """The last three and the last two words (six and four wide characters); numbers as a sign."""
    words = _counted(text)
    return _last(words, len(words))


def occurrences(answer: str, end: str, wanted=lambda word: True) -> dict[str, tuple[bool, bool]]:
    """The word groups of ``tails`` that an answer has: whether at an end and whether inside a sentence;
    only those whose last word is ``wanted``.

    An unmarked end is one only in a short answer; elsewhere it may be a cut and says nothing."""
    found: dict[str, tuple[bool, bool]] = {}
    for part in sentences(answer):
        words = _counted(part)
        for k, word in enumerate(words, 1):
            if not wanted(word):
                continue
            ended = k == len(words)
            if ended and not (end == "short" or _CLOSED.search(part)):
                continue
            for tail in _last(words, k):
                before = found.get(tail, (False, False))
                found[tail] = (before[0] or ended, before[1] or not ended)
    return found


def unclosed(line: str) -> bool:
    """Whether a bracket or quotation mark is opened and not closed; “ closes where „ stands open."""
    opened = None
    for sign in re.findall(r"[„“”]", line):
        opened = None if opened and (sign == "”" or (sign == "“" and opened == "„")) else None if sign == "”" else sign
    return opened is not None or any(line.count(a) > line.count(b) for a, b in _PAIRS)


def ending(answer: str) -> str:
    """How an answer ends: ``closed``, ``open`` (cut off), or ``list`` or ``short``, where the corpus decides."""
    text = _CITATION.sub("", answer.rstrip()).rstrip()
    lines = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
    if not lines:
        return "closed"
    last = lines[-1].strip()
    if re.fullmatch(r"(?:[-*•>]|#{1,6}|\d{1,3}[.)])", last):
        return "open"
    if unclosed(last):
        return "open"
    if _CLOSED.search(last):
        return "closed"
    if last.startswith("#"):
        return "closed" if len(lines) == 1 else "list"
    if not last[-1].isalnum():
        return "open"
    listed = [x.strip() for x in lines if _LISTED.match(x)]
    if _LISTED.match(last):
        return "open" if any(_CLOSED.search(x) for x in listed[:-1]) else "list"
    if len(lines) == 1 and len(sentences(text)) <= 1:
        return "short"
    return "open"


def _key(answer: str) -> int:
    """The same for answers of the same letters and digits."""
    return int.from_bytes(hashlib.blake2b(_plain(answer).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_TESTED = pa.schema(
    [("turn_id", pa.string()), ("refused", pa.bool_()), ("asked", pa.list_(pa.int64())), ("defect", pa.string()), ("ending", pa.string()), ("tails", pa.list_(pa.string())), ("words", pa.int32()), ("openings", pa.list_(pa.string())), ("said", pa.int64())]
)
_TESTED_DDL = "turn_id string, refused boolean, asked array<bigint>, defect string, ending string, tails array<string>, words int, openings array<string>, said bigint"


def _test(shared):
    """A mapInArrow function: what each pair shows by itself, under the broadcast profiles of languages."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held = []
            for turn, question, answer, refused, asked in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if not answer or not any(c.isalnum() for c in answer):
                    yield turn, refused, asked, "empty", "closed", [], 0, [], None
                    continue
                question = question if question and any(c.isalnum() for c in question) else ""
                held.append((turn, question, answer, refused, asked, "copy" if question and is_copy(question, answer) else None))
            tried = [h for h in held if h[1] and not h[5]]
            others = iter(speak_otherwise(shared.value, [h[1] for h in tried], [h[2] for h in tried]) if tried else ())
            for turn, question, answer, refused, asked, defect in held:
                if question and not defect and next(others):
                    defect = "other_language"
                openings = sorted({opening(x) for x in sentences(answer)})
                yield turn, refused, asked, defect, ending(answer), tails(_CITATION.sub("", answer)), len(_WORD.findall(answer)), openings, _key(answer)

    return lambda batches: emit(rows(batches), _TESTED)


def _kinds(question: Column) -> Column:
    """Three numbers of a question, each the least hash of its words under another seed.

    Near-equal questions share each with the probability of their likeness, unrelated ones hardly ever, so
    the number of distinct ones counts near-equal questions about once."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    # Pairs of words, or of wide characters, which stand without spaces between them.
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(words[0]) - 1, F.lit(1))), lambda i: F.substring(words[0], i, F.lit(2)))
    )
    return F.array(*(F.array_min(F.transform(pairs, lambda p, s=seed: F.xxhash64(F.lit(s), p))) for seed in range(3)))


def refusal_openings(tested: DataFrame) -> DataFrame:
    """(opening) of the sentences that decline to answer, from (refused, asked, openings).

    ``asked`` are the numbers of ``_kinds``; distinct ones are counted by sketches, which a group unites."""
    said = tested.select("refused", "asked", F.explode("openings").alias("opening"))
    sketches = [F.hll_sketch_agg(F.col("asked")[k], 10).alias(f"kinds{k}") for k in range(3)]
    counts = cut(said.groupBy("opening").agg(F.count("*").alias("n"), F.count_if("refused").alias("k"), *sketches))
    groups = minhash_groups(counts.select("opening"), "opening", grams=3, similarity=0.8)
    whole = counts.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    united = [F.hll_sketch_estimate(F.hll_union_agg(f"kinds{k}")) for k in range(3)]
    pooled = (
        counts.join(groups, "opening")
        .groupBy("group")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.least(*united).alias("questions"))
        .join(F.broadcast(whole))
    )
    base = F.greatest(F.lit(0.005), F.least(F.lit(0.2), F.col("all_k") / F.col("all_n")))
    ratio = F.col("k") * F.log(REFUSED_SHARE / base) + (F.col("n") - F.col("k")) * F.log((1 - REFUSED_SHARE) / (1 - base))
    chosen = pooled.where((F.col("questions") >= QUESTIONS) & (ratio > EVIDENCE)).select("group")
    return groups.join(chosen, "group", "left_semi").select("opening")


_OCCURRENCES = pa.schema([("tail", pa.string()), ("said", pa.int64()), ("ended", pa.bool_())])


def cut_short(answers: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(turn_id) of ``doubtful(turn_id, said, tail)`` none of whose tails is at an end in ``ENDS_SHARE`` of
    the other ``answers(answer)`` that have it.  Equal answers count once, and not for one another."""
    spark = answers.sparkSession
    # Two sifts of a fixed size: the groups looked for, and before that their last words.
    last = F.when(F.right("tail", F.lit(1)).rlike("[㐀-鿿]"), F.right("tail", F.lit(1))).otherwise(F.substring_index("tail", " ", -1))
    sifts = np.zeros((2, TAIL_CELLS), np.uint8)
    for row, text in enumerate((F.col("tail"), last)):
        cells = doubtful.select((F.crc32(text) % TAIL_CELLS).alias("cell")).distinct().toArrow()
        sifts[row, cells.column(0).to_numpy()] = 1
    shared = spark.sparkContext.broadcast(sifts.tobytes())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, ends, known = shared.value[:TAIL_CELLS], shared.value[TAIL_CELLS:], {}

        def cell(text: str) -> int:
            return zlib.crc32(text.encode("utf-8", "surrogatepass")) % TAIL_CELLS

        def wanted(word: str) -> bool:
            if (found := known.get(word)) is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[word] = bool(ends[cell(word)])
            return found

        def out():
            for batch in batches:
                for answer in batch.column(0).to_pylist():
                    if answer:
                        key = None
                        for tail, (ended, _) in occurrences(answer, ending(answer), wanted).items():
                            if sought[cell(tail)]:
                                key = _key(answer) if key is None else key
                                yield tail, key, ended

        return emit(out(), _OCCURRENCES)

    met = answers.select("answer").mapInArrow(find, "tail string, said bigint, ended boolean")
    met = cut(met.join(doubtful.select("tail").distinct(), "tail", "left_semi").groupBy("tail", "said").agg(F.max("ended").alias("ended")))
    every = met.groupBy("tail").agg(F.count("*").alias("n"), F.count_if("ended").alias("ends"))
    own = met.withColumn("own", F.lit(1)).withColumnRenamed("ended", "own_end")
    n, ends = F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0)), F.coalesce("ends", F.lit(0)) - F.coalesce(F.col("own_end").cast("int"), F.lit(0))
    share = F.when(n > 0, ends / n).otherwise(0.0)
    rated = doubtful.join(every, "tail", "left").join(own, ["tail", "said"], "left").select("turn_id", share.alias("share"))
    return rated.groupBy("turn_id").agg(F.max("share").alias("share")).where(F.col("share") < ENDS_SHARE).select("turn_id")


def defective_pairs(turns: DataFrame) -> DataFrame:
    """(turn_id, defect): the first that applies of empty, refusal, copy, other_language, truncated."""
    small_batches(turns.sparkSession)
    rows = valid_turns(turns, "question", "answer", "status").where(F.col("status").isin("succeeded", "refused"))
    rows = spread(cut(rows.drop("ingested_at")))
    shared = turns.sparkSession.sparkContext.broadcast(profiles(rows))
    asked = rows.select("id", "question", "answer", (F.col("status") == "refused").alias("refused"), _kinds(F.col("question")).alias("asked"))
    tested = cut(asked.mapInArrow(_test(shared), _TESTED_DDL))
    openings = tested.where("defect is null or defect <> 'empty'").select("turn_id", F.explode("openings").alias("opening"))
    # Few openings decline; where they are as few as they should be, no answer moves for them.
    refusing = broadcast_small(cut(refusal_openings(tested)).withColumn("declines", F.lit(True)))
    refused = (
        openings.join(refusing, "opening", "left")
        .groupBy("turn_id")
        .agg(F.count("*").alias("all"), F.count("declines").alias("declining"))
        .where("all = declining")
        .select("turn_id", F.lit(True).alias("refusal"))
    )
    # A few words without a sentence around them (a name, a place, yes or no) are an answer.
    brief = (F.col("ending") == "short") & (F.col("words") <= 3)
    doubtful = tested.where(F.col("ending").isin("list", "short") & ~brief).select("turn_id", "said", F.explode("tails").alias("tail"))
    cut_off = cut_short(rows, doubtful).withColumn("cut_off", F.lit(True))
    defect = (
        F.when(F.col("defect") == "empty", "empty")
        .when(F.col("refusal"), "refusal")
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when((F.col("ending") == "open") | F.col("cut_off"), "truncated")
    )
    return (
        tested.select("turn_id", "defect", "ending")
        .join(refused, "turn_id", "left")
        .join(cut_off, "turn_id", "left")
        .select("turn_id", defect.alias("defect"))
        .where("defect is not null")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "chat_turns"))


QUERIES = {"p2_found": p2_found}
ORACLE: dict[str, str] = {}
