"""The languages of questions and answers, by profiles of letter triples learnt from the pairs themselves.

Questions whose script or function words tell their language are the seeds; each seed labels its
question and its answer, for most answers are in the language of their question.  The triples of all
labelled texts are counted per language in a fixed number of cells, so the profiles are as small for a
large corpus as for a small one, and a text needs no function words to be told: names and words that
all languages share weigh the same in all profiles and so tell nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells in which the triples of a language are counted.
CELLS = 1 << 16
#: What one language must exceed another by, in nats a triple and in all, to be told from it, and the triples
#: that a text must have for it: a name or two look like some language, but are in none.
EACH, ALL, LEAST = 0.2, 8.0, 26

# Common function words of the languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are this was by from at which or an be not his her their its who what where does how why when only than says about because while between before after".split(),
    "fr": "le la les de des du et en un une est que qui dans pour sur au aux ce cette par pas ne se son sa ses il elle avec sont comme plus mais ou où dit entre sans avant après parce chaque quel quelle l d qu c n s".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei einer um am sind noch wie einem über einen so zum vor durch wo warum ohne jede jeder wird schreibt".split(),
    "es": "el la los las de y en un una que es por con para su se no al lo como más del sus le ha este esta entre cuando muy sin sobre también hasta hay donde quien desde todo nos según dice cada qué por cómo dónde antes después porque".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "ru", "zh")
_VOTES: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _VOTES.setdefault(_w, []).append(_code)

_OTHER = re.compile(r"[\W\d_]+")
#: Letters of scripts that none of the languages is written in.
_FOREIGN = re.compile("[Ͱ-Ͽ԰-῿぀-ヿ가-힯]")


def script(text: str) -> str | None:
    """zh or ru where most of ``text`` is in Han or Cyrillic letters."""
    counts = {"zh": len(re.findall(r"[㐀-鿿]", text)) / 1.6, "ru": float(len(re.findall(r"[Ѐ-ӿ]+", text)))}
    best = max(counts, key=counts.get)
    return best if counts[best] and counts[best] >= max(1, len(re.findall(r"[a-zà-öø-ÿœšž]+", text.lower()))) else None


def seed(text: str) -> str | None:
    """The language that the script or the function words of ``text`` tell, or None where there is too little."""
    if code := script(text):
        return code
    latin = re.findall(r"[a-zà-öø-ÿœšž]+", text.lower())
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for word in latin:
        for code in (codes := _VOTES.get(word, ())):
            votes[code] += 1 / len(codes)
    first, second = sorted(votes.values(), reverse=True)[:2]
    if first < 1 or first < 1.2 * second:
        return None
    return max(votes, key=votes.get)


def _triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the letter triples of all ``texts``, one after the other, and how many each text has."""
    plain = [f" {_OTHER.sub(' ', t.lower()).strip()} " for t in texts]
    sizes = np.array([max(len(t) - 2, 0) for t in plain], np.int64)
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    cells = (mixed >> np.uint64(48)).astype(np.int64)
    lengths = np.array([len(t) for t in plain], np.int64)
    starts = np.cumsum(lengths) - lengths
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return cells[inside], sizes


def profiles(pairs: DataFrame) -> np.ndarray:
    """Log-likelihoods (language, cell) from ``pairs(question, answer)``; a language without text has all cells alike.

    What reaches the driver is one count a language and cell at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(LANGUAGES) * CELLS, np.int64)
        for batch in batches:
            texts, labels = [], []
            for question, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = seed(question) if question else None
                if code:
                    texts += [question, answer or ""]
                    labels += [LANGUAGES.index(code)] * 2
            if texts:
                cells, sizes = _triples(texts)
                sums += np.bincount(np.repeat(np.array(labels), sizes) * CELLS + cells, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    most = 2 * pairs.sparkSession.sparkContext.defaultParallelism
    held = pairs.select("question", "answer")
    held = held.coalesce(most) if held.rdd.getNumPartitions() > most else held
    rows = held.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(LANGUAGES) * CELLS)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return learnt(counts.reshape(len(LANGUAGES), CELLS))


def learnt(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * CELLS)).astype(np.float32)


def scores(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, language): log-likelihoods of ``texts``; and their numbers of triples."""
    cells, sizes = _triples(texts)
    sums = np.zeros((len(table), len(cells) + 1))
    np.cumsum(table[:, cells], axis=1, out=sums[:, 1:])
    ends = np.cumsum(sizes)
    return (sums[:, ends] - sums[:, ends - sizes]).T, sizes


def _foreign(text: str) -> bool:
    letters = len(re.findall(r"[^\W\d_]", text)) if _FOREIGN.search(text) else 0
    return letters > 3 and 2 * len(_FOREIGN.findall(text)) > letters


def _told(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, sizes, told): ``told`` where one language clearly leads all others."""
    found, sizes = scores(table, texts)
    order = np.sort(found, axis=1)
    lead = order[:, -1] - order[:, -2]
    return found, sizes, (lead >= ALL) & (lead >= EACH * sizes) & (sizes >= LEAST)


def differing(table: np.ndarray, questions: list[str], answers: list[str], whole: list[str] | None = None) -> list[str | None]:
    """Of each pair the answer's language if it is another than the question's, None if not or if unknown.

    ``whole`` are the answers with their quotations, which are asked where the answers without do not tell.  An
    answer mainly in a script that none of the languages has is "?" unless its question is so too."""
    asked, _, _ = _told(table, questions)
    order = np.sort(asked, axis=1)
    own, sure = np.argmax(asked, axis=1), order[:, -1] - order[:, -2] >= ALL / 2
    said, _, told = _told(table, answers)
    best = np.argmax(said, axis=1)
    # Few answers are told by their quotations only.
    again = [k for k in range(len(answers)) if whole is not None and not told[k] and whole[k] != answers[k]]
    if again:
        more, _, told_more = _told(table, [whole[k] for k in again])
        best[again], told[again] = np.argmax(more, axis=1), told_more
    found: list[str | None] = [LANGUAGES[b] if t else None for b, t in zip(best, told & sure & (best != own))]
    for k, (question, answer) in enumerate(zip(questions, answers)):
        # Scripts tell without any text to learn from; Latin letters do not, names being written in them everywhere.
        if (code := script(answer)) and script(question) != code:
            found[k] = code
        elif _foreign(answer):
            found[k] = None if _foreign(question) else "?"
    return found
