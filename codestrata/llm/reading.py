"""Reading level of English prose by the median of classic readability grades.

Prose is separated from code, tables, diagrams, traces and headings; sentences, words, letters and
syllables (hyphenation-style rules) give six grade estimates, whose median is the document's grade.
Cut points between the levels are fitted on rated documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.normal import STAGES, fold
from codestrata.session import checkpointed, spread

# Frequent function words by language, to tell which one a text is written in.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been this that these those with for from by on at as it its not but if then than when while because which what who you your we our they their each every any another can should has have had will would may must there here into after before between without such no only so most",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind war wird werden mit auf für von zu im am bei nach aus auch sich wenn dann weil dass wie aber nur noch es er sie wir ihr man jede jeder jedes jeden diese dieser dieses diesen kein keine vor über unter zwischen ohne durch",
    "fr": "le la les un une des du de et ou ne pas est sont était être avec pour par sur dans en au aux ce cet cette ces qui que quoi dont où il elle nous vous ils elles on son sa ses leur leurs mais si donc car chaque tout toute tous avant après entre sans sous plus très",
    "es": "el la los las un una unos unas y o no es son era ser con para por sobre en al del de que quien cual donde él ella nosotros ellos se su sus lo le les pero si cuando como porque cada todo toda todos antes después entre sin bajo más muy este esta estos estas ese esa",
}
_LANGUAGES = {lang: frozenset(fold(w) for w in words.split()) for lang, words in FUNCTION_WORDS.items()}

_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.DOTALL | re.MULTILINE)
_HTML_CODE = re.compile(r"<(pre|code|script|style|table|svg)\b[^>]*>.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
_HTML_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h\d|br|tr|td)\b[^>]*>", re.IGNORECASE)
_BROKEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")
_NOT_PROSE = re.compile(
    r"""(?:
        [-=*_~+|:\s]{3,}                              # rule, table border
      | at\s\S+\s*\(.*                                # stack frame
      | (?:\w*Error|\w*Exception|Traceback|File\s").*  # error line
      | (?:graph|flowchart|sequenceDiagram|classDiagram|digraph)\b.*
      | [^-=>]*(?:-->|==>|->>).*                      # diagram edge
      | (?:(?:[-*+]|\d+[.)])\s+)?`[^`]*`\s*           # a lone code span
      | [\w.-]+(?:/[\w.-]+)+(?::\d+)*\s*              # a lone path
      | .*[;{}]\s*                                    # a line of code
      | (?:\$|>>>|PS>)\s.*                            # a command
      | (?:diff|index|@@|\+\+\+|---)\s.*              # a patch
    )$""",
    re.VERBOSE,
)
_CODE_MARK = re.compile(r"[=(){}\[\];<>]")
_BULLET = re.compile(r"(?:[-*+•]|\d+[.)])\s+")
_SPAN = re.compile(r"`[^`\n]*`|\((?:see )?[A-Za-z]+[a-z][A-Z]\w*\)|https?://\S+")
_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:['’-][A-Za-zÀ-ÿ]+)*")
_SENTENCE_END = re.compile(r"[.!?]+(?=[\s\"')\]]|$)(?<![ (][A-Za-z]\.[A-Za-z]\.)(?<!\bvs\.)")
_MARKED = re.compile(r"[a-z][A-Z]|[_/\\\d]")
_HAS_WORD = re.compile(r"[A-Za-zÀ-ÿ]").search
_VOWELS = frozenset("aeiouyäöüàâéèêëîïôûùáíóúœ")

# Hyphenation patterns of vowels that meet, as in pattern hyphenation: the digit stands between letters, the
# highest digit of all patterns that fit counts, odd digits divide, '.' is the word's edge.
PATTERNS = (
    "i1a ti2al ci2al ti2an ci2an gi2an gi2a si2a i2age i1o ti2on si2on ci2on xi2on gi2on lli2on ni2on ti2ou ci2ou gi2ou xi2ou i1u "
    "i1et i1er .pi2er .ti2er ldi2er i1est sci3en i1ence i1ent ti2en ci2en i1ing i1i "
    "e1al. .re1act .re1al e2ason ide1a are1a the1a cre1a cre2atu e1ate e2aten oce2an ine1ar ucle1ar e1o pe2opl ge2ou ge2on e1um re1in re1it re1is be1in ee1i e1ing "
    "u1a gu2a qu2a u1el u1en u1et gu2e qu2e lu1id u1in. ru1in u1ing u1ity u1iti u1itou gu2i qu2i u1ou u1o qu2o uo2y a1o a1ic na1iv a1ing a1ism "
    "o1et o1em co1e co1op co1or co1in. o1ing hero1i sto1ic po1in2 o1as. ko1a o1asi y1i y1a y1o "
    "ay1e ey1e oy1e uy1e ly1er .ey2e"
)


@lru_cache(maxsize=1)
def _patterns() -> dict[str, list[tuple[int, int]]]:
    """letters -> (place, digit) of each digit above 0."""
    out: dict[str, list[tuple[int, int]]] = {}
    for pattern in PATTERNS.split():
        letters = re.sub(r"\d", "", pattern)
        digits, place = [], 0
        for c in pattern:
            if c.isdigit():
                digits.append((place, int(c)))
            else:
                place += 1
        out.setdefault(letters, []).extend(digits)
    return out


@lru_cache(maxsize=1 << 17)
def syllables(word: str) -> int:
    """Syllables of one lower-case word: its groups of vowels, divided where the hyphenation patterns say, without
    vowels that endings leave silent."""
    total = 0
    for part in re.split(r"['’-]", word):
        if not part:
            continue
        framed = f".{part}."
        level = [0] * (len(framed) + 1)
        for i in range(len(framed)):
            for j in range(i + 2, min(i + 8, len(framed) + 1)):
                for place, digit in _patterns().get(framed[i:j], ()):
                    level[i + place] = max(level[i + place], digit)
        n = 0
        for i in range(1, len(framed) - 1):
            n += framed[i] in _VOWELS and (framed[i - 1] not in _VOWELS or level[i] % 2)
        if part[0] == "y" and len(part) > 1 and level[2] % 2 and part[1] in _VOWELS:
            n -= 1  # a consonant
        if n > 1 and part.endswith("e") and part[-2] not in _VOWELS and not (part.endswith("le") and len(part) > 2 and part[-3] not in _VOWELS):
            n -= 1  # silent e
        elif n > 1 and part.endswith(("ed", "es")) and part[-3:-2] not in _VOWELS and not part.endswith(("ted", "ded", "ses", "zes", "ces", "ges", "ches", "shes", "xes", "les")) and not (part.endswith("led") and part[-4:-3] not in _VOWELS):
            n -= 1
        elif n > 1 and part.endswith("les") and len(part) > 3 and part[-4] in _VOWELS:
            n -= 1
        n += part.endswith(("ism", "isms", "thm"))
        total += max(1, n)
    return total


def _wrapped(lines: list[str]) -> bool:
    """Whether lines were broken to a width: the next line's first word would mostly not have fitted."""
    width = max(map(len, lines))
    full = sum(len(line) + 1 + len(after.split(None, 1)[0]) > width for line, after in zip(lines, lines[1:]))
    return full >= 0.7 * (len(lines) - 1)


def prose_lines(text: str) -> list[str]:
    """Paragraphs, list items and single-line sentences of running text.

    Lines that were wrapped are joined (also where a word was hyphenated); lines that were not stand for
    themselves. Code, tables, diagrams, traces, commands and headings are left out.
    """
    plain_ascii = text.isascii()
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "<" in text:
        text = _HTML_CODE.sub("\n\n", text)
        text = _HTML_BLOCK.sub("\n\n", text)
    if "\\n" in text:
        text = text.replace("\\n", "\n")
    for pattern, replacement, needed in STAGES[:6]:
        if needed in text if needed else not plain_ascii:
            text = pattern.sub(replacement, text)
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if len(block) > 1 and not _wrapped(block):
            out.extend(block)
        elif block:
            out.append(_BROKEN.sub("", "\n".join(block)) if len(block) > 1 else block[0])
        block.clear()

    for line in text.splitlines():
        bare = line.lstrip(" \t>")
        if not bare or (bare[0] in "|#" or _NOT_PROSE.match(bare)) or line.startswith(("    ", "\t")) and _CODE_MARK.search(line):
            close()
            continue
        if bullet := _BULLET.match(bare):
            close()
            bare = bare[bullet.end() :]
        if bare := bare.strip():
            block.append(bare)
    close()
    return out


_BITS = 40  # of each count in a packed number; a text has fewer words than 2**40


@lru_cache(maxsize=1 << 17)
def _facts(word: str) -> int:
    """One number that packs 1, letters, syllables, 3+ syllables, 7+ letters, then 1 per language that has it as a function word.

    Packed numbers times their counts add up like vectors, in one step per word.
    """
    n = syllables(word)
    facts = (1, len(word), n, n >= 3, len(word) >= 7, *(word in common for common in _LANGUAGES.values()))
    return sum(int(f) << _BITS * i for i, f in enumerate(facts))


def profile(text: str) -> tuple[int, int, dict[str, int], int, int, int, int]:
    """(words, sentences, function words by language, letters, syllables, words of 3+ syllables, words of 7+ letters) of the prose."""
    sentences = 0
    counts: Counter[str] = Counter()
    for line in prose_lines(text):
        if "`" in line or "(" in line or "://" in line:
            line = _SPAN.sub(" ", line)
        if _MARKED.search(line):  # identifiers, paths and numbers are no words, but may end a sentence
            line = " ".join([x if x.islower() and x.isalpha() or not _MARKED.search(x) else x[-1] if x[-1] in ".!?" else "" for x in line.split()])
        sentences += sum(_HAS_WORD(x) is not None for x in _SENTENCE_END.split(line))
        counts.update(_WORD.findall(line.lower()))
    packed = sum(map(mul, map(_facts, counts), counts.values()))
    words, letters, beats, long_words, wide_words, *known = (packed >> _BITS * i & (1 << _BITS) - 1 for i in range(5 + len(_LANGUAGES)))
    return words, sentences, dict(zip(_LANGUAGES, known)), letters, beats, long_words, wide_words


def grades(words: int, sentences: int, letters: int, beats: int, long_words: int, wide_words: int) -> list[float]:
    """Flesch-Kincaid, Gunning fog, SMOG, automated readability, Coleman-Liau and LIX (as a grade)."""
    per_sentence, share_long = words / sentences, long_words / words
    return [
        0.39 * per_sentence + 11.8 * beats / words - 15.59,
        0.4 * (per_sentence + 100 * share_long),
        1.043 * math.sqrt(30 * long_words / sentences) + 3.1291,
        4.71 * letters / words + 0.5 * per_sentence - 21.43,
        0.0588 * 100 * letters / words - 0.296 * 100 * sentences / words - 15.8,
        (per_sentence + 100 * wide_words / words) / 5,
    ]


def reading_grade(text: str | None, least_words: int = 60) -> float | None:
    """The median grade of a text whose prose is English and has least_words words or more; else None."""
    if not text:
        return None
    words, sentences, known, *rest = profile(text)
    if words < least_words or known["en"] < 0.15 * words or known["en"] <= max(known[k] for k in known if k != "en"):
        return None
    return float(median(grades(words, sentences, *rest)))


def document_grades(documents: DataFrame, least_words: int = 60) -> DataFrame:
    """(doc_id, grade) of every document with enough English prose; null, empty and other texts give no row."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            grade = [reading_grade(t, least_words) for t in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": pd.array(grade, dtype="Float64")}).dropna()

    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    return texts.mapInPandas(batches, "doc_id long, grade double")


def fit_cuts(rated: list[tuple[float, float]], levels: int = 4) -> list[float]:
    """Cut points between levels from (grade, level) pairs: each minimises the misplaced pairs at its border.

    Without any pair on one side of a border the published school stages (grades 6, 10 and 16) are taken.
    """
    school = [6.0, 10.0, 16.0]
    ordered = sorted(rated)
    cuts = []
    for level in range(1, levels):
        above = [y > level for _, y in ordered]
        if not ordered or all(above) or not any(above):
            cuts.append(school[min(level, len(school)) - 1])
            continue
        wrong = sum(not a for a in above)  # cut below everything: all count as above
        best, places = wrong, [0]
        for i, a in enumerate(above, 1):
            wrong += 1 if a else -1
            if i < len(above) and ordered[i][0] == ordered[i - 1][0]:
                continue  # no cut can part equal grades
            if wrong < best:
                best, places = wrong, [i]
            elif wrong == best:
                places.append(i)
        i = places[len(places) // 2]
        low = ordered[i - 1][0] if i else ordered[0][0] - 1
        high = ordered[i][0] if i < len(ordered) else ordered[-1][0] + 1
        cuts.append((low + high) / 2)
    return [max(cuts[: i + 1]) for i in range(len(cuts))]


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = 60, most_rated: int = 50_000) -> DataFrame:
    """(doc_id, level, grade): every document whose main text is English prose, on the scale of the labels.

    The cut points are fitted on rated documents, `most_rated` at most, chosen by a hash of their id; a
    document's rating is the median of its raters. Grades of all documents are computed in one pass and
    checkpointed as (doc_id, grade); exact repeats of a row come out once, texts that differ under one
    doc_id come out once with their highest grade.
    """
    graded = checkpointed(document_grades(documents, least_words).groupBy("doc_id").agg(F.max("grade").alias("grade")))
    rating = labels.where("level between 1 and 4").distinct().groupBy("doc_id").agg(F.percentile("level", 0.5).alias("rating"))
    sample = rating.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)
    rated = [(r.grade, r.rating) for r in sample.join(graded, "doc_id").select("grade", "rating").collect()]
    cuts = fit_cuts(rated)
    level = F.lit(1)
    for cut in cuts:
        level = level + (F.col("grade") > cut).cast("int")
    return graded.select("doc_id", level.cast("int").alias("level"), "grade")
