"""Keyword stuffing, link lists and tag lists.

A page is judged by what is left of it without commit and diff headers, every line as often as it
is there; only a line that a diff removes and adds again, blanks apart, counts once. From it come
the shares of the top words and word pairs, the share of repeated lines, the share of characters in
links, the words a link outside links, the share of links that change notes have, the density of
separators, and the share of function words of the page's language; thresholds on them are given by language. The number
of hosts a link is only measured: a list may lead to one shop. Repeated code and test data are told from stuffing by
their code signs, digits, function words and the share of characters in lines of code or data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from segloom.functions.columns import pick

# Function words by language.
FUNCTION_WORDS = {
    "en": "a an and are as at be but by can did do does for from had has have if in into is it its "
    "not of on or so than that the their then there this to was were when which who will with you we",
    "de": "aber als an auf aus bei das dem den der des die doch ein eine einem einen einer es für hat "
    "im in ist jetzt mit nach nicht noch nur oder sich sie sind über um und vom von war wenn wie wird "
    "wurde zu zum zur beim",
    "fr": "à au aux avec ce ces cette dans de des deux du elle en est et était il la le les mais ne ou "
    "par pas plus pour que qui sa se si son sur un une",
    "es": "a al como con cuando de del dos el en es esta este la las lo los más no o para pero por que "
    "se según si sin sobre su un una y",
    "ru": "а без бы был было в во все для до же за и из или к как когда на не но о об от по при с со "
    "так то только у что это если",
}
# Function words that are also parts of names of people and places.
_PARTICLES = frozenset("a al am an at auf aus bei d da das de del dem den der des die du el en in la las le les los "
                       "on sur vom von y zu zum zur à au aux".split())  # fmt: skip
# Function characters of Chinese, each counted as a word.
FUNCTION_CHARACTERS = "的了在是和有不为与中会当时已被把从到对这那也就并里"

_FUNCTION_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}

_HEADER = re.compile(
    r"commit [0-9a-f]{7,}|From [0-9a-f]{7,}|(?:Author|Date|From|Committer|AuthorDate|Signed-off-by|Co-authored-by):"
    r"|diff --git |index [0-9a-f]{4,}|--- |\+\+\+ |@@ |(?:new|deleted) file mode |similarity index |rename (?:from|to) "
)
_SUBJECT = re.compile(r"Subject:\s*(?:\[[^\]]*\]\s*)?")
_URL = re.compile(r"https?://([^\s/)\]\"'>|]+)[^\s)\]\"'>|]*", re.I)
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[url=[^\]]*\].*?\[/url\]|\[[^\]\n]*\]\(https?://[^)\s]*\)|https?://[^\s)\]\"'>|]+", re.I
)
_MARKUP = re.compile(r"</?a\b[^>]*>|\[/?url[^\]]*\]|https?://[^\s)\]\"'>|]+", re.I)
_WORD = re.compile(r"[^\W_]+")
# Scripts without blanks: Chinese characters, of which each is a word, and kana, Thai, Lao, Tibetan, Burmese and Khmer.
_IDEOGRAPHS = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_UNSPACED = "\u3041-\u30ff\u31f0-\u31ff\uff66-\uff9f\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3"
_HAN = re.compile(f"[{_IDEOGRAPHS}]")
_RUN = re.compile(f"[{_IDEOGRAPHS}{_UNSPACED}]")
_PART = re.compile(f"[{_IDEOGRAPHS}]|([{_UNSPACED}]+)|[^\\W_{_IDEOGRAPHS}{_UNSPACED}]+")
_FUNCTION_CHARACTER = re.compile(f"[{FUNCTION_CHARACTERS}]")
_CYRILLIC = re.compile(r"[а-яё]")
#: Tags, also without blanks between; no anchors, numbers of issues, colours or directives of the C preprocessor.
_TAG = re.compile(
    r"(?<![\w&/])(?!#(?:include|define|undef|ifn?def|endif|if|elif|else|pragma|error|warning|(?:end)?region)\b)"
    r"(?!#(?=[a-f]*\d)(?:[\da-f]{3,4}|[\da-f]{6}|[\da-f]{8})\b)(?:#\d*[^\W\d]\w*)+",
    re.I,
)
_SEPARATOR = re.compile(r"[,;|·•/#@–—]| - ")
_CODE = re.compile(r"[(){}\[\]=<>\"_+*&%$\\`^~]|;$", re.M)
#: A line of code or data: a comment, a statement, markup, a ``name: value`` or a ``name = value``.
_CODE_LINE = re.compile(
    r"(?://|/\*|\*/|#\s|--\s|<!--|[{}\[\]()]|</?[a-z])"
    r"|(?:- )?[\"']?[a-z_][\w.-]*[\"']?\s*(?::|=|:=|\+=|-=)(?:\s|$)"
    r"|(?:return|import|yield|raise|throw|await|assert|goto|use|package|let|var|const|def|class|func|fn|public|private"
    r"|static|void|int) [\w.*(]+(?:$|[ ,;:(.=])"
    r"|(?:if|elif|while|for|switch|else|try|except|catch)\b.*[:{]$|for \w+ in |from [\w.]+ import |SELECT .* FROM |INSERT INTO "
    r"|.*(?:[;{}]$|\w\(|\w\[|==|!=|:=|=>|->|::|&&|\|\||</)"
)
#: Links of change notes and lock files: to issues, changes and archives, by number, or as a trailer with a number.
_WORK_LINK = re.compile(
    r"\[[^\]\n]*#\d+\]\(|\S*/(?:issues|pulls?|merge_requests|commits?|compare|bugs|browse|tickets?|changes?)/"
    r"|\S*\.(?:tgz|tar\.\w+|t[bx]z|zip|whl|jar|gem|crate|git|deb|rpm)(?:[#?]\S*)?$",
    re.I,
)
_TRAILER = re.compile(
    r"(?:Link|See(?:[- ]also)?|Bug|Bug-?Link|Issue|Closes|Fixes|Refs?|References|Reviewed-on|Reported-by|Discussion)"
    r":?\s+(https?://\S*/[^\s/]*\d[^\s/]*/?)",
    re.I,
)
_DIGIT = re.compile(r"\d")


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language.

    A page is stuffed with keywords if it has at least ``words`` words, its three top words and
    word pairs have the given shares, at most ``variety`` of its words differ (with ``separators`` a
    word, ``separated_variety``), and function words and code signs are at most the given numbers a
    word, words with digits and characters in lines of code or data at most the given shares. If
    ``repeated_lines`` of its lines stand elsewhere in it, its top words and pairs don't matter. It
    is a list of links if these have the share ``link_text`` of its characters, with at most
    ``running`` words between two of them (``sentence_link_text`` if these words have more function
    words than keywords may), and at most ``work_links`` of them are such as change notes have. It is a list of tags by the rest.
    """

    words: int = 20
    top_words: float = 0.22
    top_pairs: float = 0.10
    variety: float = 0.58
    separators: float = 0.3
    separated_variety: float = 0.66
    function_words: float = 0.20
    code: float = 0.25
    repeated_lines: float = 0.5
    code_lines: float = 0.5
    digits: float = 0.6
    links: int = 4
    link_text: float = 0.5
    running: float = 3.0
    sentence_link_text: float = 0.8
    work_links: float = 0.5
    tags: float = 0.5


#: By the highest share of function words in stuffed pages of the test data and the lowest in others that
#: repeat themselves: en 0.16, de 0.15 and 0.30, fr 0.16 and 0.22, es 0.08 and 0.24, ru 0.00 and 0.16.
LIMITS = {
    "": Limits(),
    "en": Limits(function_words=0.20),
    "de": Limits(function_words=0.20),
    "fr": Limits(function_words=0.19),
    "es": Limits(function_words=0.18),
    "ru": Limits(function_words=0.15),
    "zh": Limits(function_words=0.18),
}


def body_lines(text: str) -> list[str]:
    """Lines without commit and diff headers, diff signs and outer blanks.

    A removed line that is added again counts as one, as often as both are there.
    """
    lines, removed, added = [], Counter(), Counter()
    for line in text.splitlines():
        if _HEADER.match(line):
            continue
        sign = line[:1]
        if sign and sign in "+-":
            line = line[1:]
        line = _SUBJECT.sub("", line, count=1) if line.startswith("Subject:") else line
        line = line.strip()
        if line:
            lines.append((sign == "-", line))
            (removed if sign == "-" else added)[line] += sign in "+-"
    again = removed & added
    kept = []
    for gone, line in lines:
        if gone and again[line] > 0:
            again[line] -= 1
        else:
            kept.append(line)
    return kept


def _visible(text: str) -> int:
    return len("".join(text.split()))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; in scripts without blanks Chinese characters, and pairs of neighbouring other ones."""
    if not _RUN.search(text):
        return _WORD.findall(text)
    words = []
    for m in _PART.finditer(text):
        run = m.group()
        words += [run[i : i + 2] for i in range(len(run) - 1)] if m.group(1) and len(run) > 1 else [run]
    return words


def language(lang: str | None, text: str | None) -> str:
    """The language as ``FUNCTION_WORDS`` names it, or ``zh``.

    It is guessed from the text if it is null or unknown, and if the text has more function words
    of another language, as the column is of the message only. That takes four different ones, two
    of which aren't particles of names; without them an unknown language is English, the usual one of commits.
    """
    name = re.split("[-_]", (lang or "").strip().lower(), maxsplit=1)[0]
    known = name in _FUNCTION_WORDS or name == "zh"
    counts = Counter(_WORD.findall((text or "").lower()))
    found = {x: counts.keys() & own for x, own in _FUNCTION_WORDS.items()}
    often = {x: sum(map(counts.__getitem__, words)) for x, words in found.items()}
    best = max(often, key=lambda x: (often[x], x == name, x == "en"))
    if len(found[best]) >= 4 and len(found[best] - _PARTICLES) >= 2 and often[best] > len(_FUNCTION_CHARACTER.findall(text or "")):
        return best
    if known:
        return name
    if 2 * sum(n * len(_HAN.findall(w)) for w, n in counts.items()) > sum(n * len(w) for w, n in counts.items()):
        return "zh"
    return "ru" if 2 * sum(n for w, n in counts.items() if _CYRILLIC.match(w)) > counts.total() else "en"


def features(text: str | None, lang: str | None = None) -> dict[str, float]:
    """The measures of one page, its function words by its language; all zero without text."""
    own = _FUNCTION_WORDS.get(language(lang, text), frozenset())
    lines = body_lines(text or "")
    body = "\n".join(lines)
    links = [m.group() for m in _LINK.finditer(body)]
    hosts = {m.group(1).lower() for m in _URL.finditer(body)}
    plain = _MARKUP.sub(" ", body)
    words = words_of(plain.lower())
    named = [w for w in words if not w.isdigit()]
    n = len(named)
    counts, pairs = Counter(named), Counter(zip(named, named[1:], strict=False))
    function = sum(map(counts.__getitem__, counts.keys() & own)) + len(_FUNCTION_CHARACTER.findall(plain))
    rest = words_of(_LINK.sub(" ", body).lower())
    sentences = sum(w in own for w in rest)
    work = sum(map(bool, map(_WORK_LINK.match, links))) + sum(
        not _WORK_LINK.match(m.group(1)) for m in map(_TRAILER.fullmatch, lines) if m
    )
    tagged = sum(not w.isdigit() for t in _TAG.findall(plain.lower()) for w in words_of(t))
    size = _visible(body)
    in_code = sum(map(_visible, filter(_CODE_LINE.match, lines)))
    return {
        "words": n,
        "top_words": sum(v for _, v in counts.most_common(3)) / n if n else 0.0,
        "top_pairs": sum(v for _, v in pairs.most_common(3)) / n if n else 0.0,
        "variety": len(counts) / n if n else 0.0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "links": len(links),
        "hosts": len(hosts) / len(links) if links else 0.0,
        "link_text": sum(map(_visible, links)) / size if size else 0.0,
        "running": len(rest) / len(links) if links else 0.0,
        "running_function_words": sentences / len(rest) if rest else 0.0,
        "work_links": work / len(links) if links else 0.0,
        "separators": len(_SEPARATOR.findall(plain)) / n if n else 0.0,
        "tags": tagged / n if n else 0.0,
        "function_words": function / n if n else 0.0,
        "code": len(_CODE.findall(plain)) / n if n else 0.0,
        "code_lines": in_code / size if size else 0.0,
        "digits": sum(map(bool, map(_DIGIT.search, words))) / len(words) if words else 0.0,
    }


def kind(measures: dict[str, float], lang: str | None = None, limits: dict[str, Limits] | None = None) -> str | None:
    """``links``, ``tags`` or ``keywords`` for such a page by the limits of its language, else None."""
    table = limits or LIMITS
    at = table.get(re.split("[-_]", (lang or "").lower(), maxsplit=1)[0]) or table.get("") or Limits()
    m = measures
    sentences = m["running_function_words"] > at.function_words
    listed = m["link_text"] >= (at.sentence_link_text if sentences else at.link_text) and m["running"] <= at.running
    if m["links"] >= at.links and listed and m["work_links"] <= at.work_links:
        return "links"
    if m["words"] >= at.words // 2 and m["tags"] >= at.tags:
        return "tags"
    variety = at.separated_variety if m["separators"] >= at.separators else at.variety
    few = m["top_words"] >= at.top_words and m["top_pairs"] >= at.top_pairs
    repeated = (few or m["repeated_lines"] >= at.repeated_lines) and m["variety"] <= variety
    data = m["code"] > at.code or m["code_lines"] > at.code_lines or m["digits"] > at.digits
    if m["words"] >= at.words and repeated and m["function_words"] <= at.function_words and not data:
        return "keywords"
    return None


_MEASURES = list(features(None))
_SCHEMA = "doc_id bigint, kind string, " + ", ".join(f"{m} double" for m in _MEASURES)


def _judge(limits: dict[str, Limits] | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            langs = [language(x, t) for t, x in zip(texts, langs, strict=True)]
            rows = [features(t, x) for t, x in zip(texts, langs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([kind(r, x, limits) for r, x in zip(rows, langs, strict=True)], pa.string()),
                    *[pa.array([float(r[m]) for r in rows], pa.float64()) for m in _MEASURES],
                ],
                ["doc_id", "kind", *_MEASURES],
            )

    return kernel


def judge(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    limits: dict[str, Limits] | None = None,
) -> DataFrame:
    """A row for each document: its measures, and ``kind``, null if it is no such page.

    One pass of an Arrow kernel over the scan, no shuffle; whole texts are read. Null, empty and
    blank texts have all measures 0 and no kind; a null or unknown language is guessed
    from the text; repeated rows come out as often as they came in.
    """
    return pick(documents, doc_id=doc_id, text=text, lang=lang).mapInArrow(_judge(limits), _SCHEMA)


def spam_pages(documents: DataFrame, **names: str) -> DataFrame:
    """``doc_id`` of the pages that have a kind, each once."""
    return judge(documents, **names).where("kind IS NOT NULL").select("doc_id").distinct()
