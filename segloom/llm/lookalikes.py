"""One form for texts that look the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.session import cut

# Letters that look alike, by script, each string beside the letters of another script, Latin ones or not.
LOOKALIKES = {
    "Cyrillic": ("аеорсухѕіјһԁԛԝѵӏАВЕКМНОРСТУХЅІЈԚԜҮӀѴүԌӕӔәӘөӨӡӠћ", "aeopcyxsijhdqwvlABEKMHOPCTYXSIJQWYIVyGæÆəƏɵƟʒƷħ"),
    "Greek": ("ονρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαιυγβΘ", "ovpcjABEZHIKMNOPTYXCaiuyßƟ"),
    "Greek and Cyrillic": ("ΓΠΦΨκτφψ", "ГПФѰктфѱ"),
    "Old Cyrillic": ("Ѳѳ", "Ɵɵ"),
    "Armenian": ("օսհոզցյՕՏՍԼ", "ouhnqgjOSUL"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴᎱᎾ", "DRTiyAJEWMHYGhZbRWSVSLCPKdGBΓƟ"),
    "Coptic": ("ⲎⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲄⲠⲪ", "HKMNOPCTYXopcΓΠΦ"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
# Format characters that have a visible form, as ranges of code points.
_SHOWN = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110CD))
# Invisible characters that aren't format characters, fillers and variation selectors.
_HIDDEN = (
    (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF),
)


def _within(ch: str, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(first <= ord(ch) <= last for first, last in ranges)


def spelled(ch: str) -> str:
    """A code point as a string that looks the same, in one step; itself if there is none.

    Invisible characters are spelled by nothing, blanks of any width by a space, letters with
    accents by letter and accents, width forms by their usual form, joined letters by the single ones.
    """
    category = unicodedata.category(ch)
    if _within(ch, _HIDDEN) or (category == "Cf" and not _within(ch, _SHOWN)):
        return ""
    if category == "Zs":
        return " "
    tag, _, points = unicodedata.decomposition(ch).rpartition("> ")
    text = "".join(chr(int(p, 16)) for p in points.split())
    if not tag and text and not ch.isspace():
        return text
    if tag in ("<wide", "<narrow") or (tag in ("<isolated", "<initial", "<medial", "<final") and category[0] == "L"):
        return text
    if tag == "<compat" and category[0] in "LN" and len(text) > 1 and text.isalpha():
        return text
    return ch


class Classes:
    """Union-find over strings and code points."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x: str, y: str) -> None:
        self.parent[self.find(x)] = self.find(y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def _atoms(text: str) -> str:
    """The text spelled as far as it goes."""
    while (more := "".join(map(spelled, text))) != text:
        text = more
    return text


def rewriting(frequency: Mapping[str, int]) -> dict[str, str]:
    """For each code point that has a class, the class's representative.

    Classes are the transitive closure of spellings and look-alike letters. Single letters that
    can't be spelled further are represented by the most frequent one of them, the smaller code
    point winning ties; a class that has a spelling in several letters, or in none, is represented
    by that spelling in representatives. So a representative contains nothing that is rewritten.
    """
    classes = Classes()
    for letters, latin in LOOKALIKES.values():
        for x, y in zip(letters, latin, strict=True):
            classes.union(x, y)
    for ch in frequency:
        classes.union(ch, _atoms(ch))
    chosen: dict[str, str] = {}
    for members in classes.members().values():
        single = [m for m in members if len(m) == 1 and spelled(m) == m]
        if single:
            best = min(single, key=lambda m: (-frequency.get(m, 0), m))
            chosen.update(dict.fromkeys(members, best))
    out = {}
    for x in {*frequency, *classes.parent}:
        best = chosen.get(x) or "".join(chosen.get(a, a) for a in _atoms(x))
        if len(x) == 1 and best != x:
            out[x] = best
    return out


class Rewriter:
    """Greedy rewriting by an automaton of all patterns; the longest pattern at the leftmost place wins.

    What comes out is composed canonically, which also puts several accents of a letter in order.
    """

    def __init__(self, patterns: Mapping[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for pattern, best in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), best))
        if patterns:
            self.automaton.make_automaton()
        self.patterns = bool(patterns)
        self.plain_ascii = not any(p.isascii() for p in patterns)

    def __call__(self, text: str) -> str:
        if not self.patterns or (self.plain_ascii and text.isascii()):
            return unicodedata.normalize("NFC", text)
        parts, at = [], 0
        for last, (size, best) in self.automaton.iter_long(text):
            parts += (text[at : last + 1 - size], best)
            at = last + 1
        return unicodedata.normalize("NFC", "".join(parts) + text[at:])


def code_points(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each code point occurs in all texts.

    It comes to the driver: there are at most 1,114,112 code points, whatever the input. Each map
    task sends one row for each code point that it has.
    """
    each = texts.select(F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''")
    return {r.ch: r.n for r in each.groupBy("ch").agg(F.count("*").alias("n")).collect()}


def _form(patterns: Mapping[str, str]):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(patterns)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            form = pa.array([None if t is None else rewrite(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, form], [*batch.schema.names, "form"])

    return kernel


def consistent(texts: DataFrame, frequency: Mapping[str, int] | None = None) -> DataFrame:
    """``texts`` with ``form``, the consistent form of column ``text``.

    Without ``frequency``, code points are counted first, in all rows. Case, punctuation, line ends, tabs and the
    number of blanks stay. A null text has a null form; texts may be of any length.
    """
    patterns = rewriting(code_points(texts) if frequency is None else frequency)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", form string"
    return texts.mapInArrow(_form(patterns), schema)


def visible(form: str = "form"):
    """Whether a consistent form has any visible character."""
    return F.regexp_replace(F.col(form), r"[\s\p{Z}\p{C}]+", "") != ""


def looking_alike(texts: DataFrame) -> DataFrame:
    """``scope``, ``id``, ``text`` and ``form`` of the rows whose form stands for several texts of the scope.

    ``texts`` has columns ``scope``, ``id`` and ``text``; rows delivered again count once. Forms
    are grouped with a combining aggregation, and only those with different texts go on, so that a
    text that a third of all rows have, always stored alike, isn't gathered anywhere.
    """
    rows = consistent(texts.where("id IS NOT NULL AND text IS NOT NULL")).where(visible())
    mixed = (
        rows.groupBy("scope", "form")
        .agg(F.min("text").alias("least"), F.max("text").alias("most"))
        .where("least <> most")
        .select("scope", "form")
    )
    return rows.join(mixed, ["scope", "form"]).select("scope", "id", "text", "form").distinct()


def pairs(texts: DataFrame) -> DataFrame:
    """``scope``, ``id_a`` < ``id_b`` of rows that look alike and are stored differently.

    Different texts of a form are paired first, then their rows are attached, so equal texts are
    never paired with each other. The pairs of large classes are spread over several tasks by the
    hash of the text; the result itself has as many rows as there are such pairs.
    """
    alike = cut(looking_alike(texts))
    stored = alike.select("scope", "form", "text").distinct()
    a, b = stored.withColumnRenamed("text", "text_a"), stored.withColumnRenamed("text", "text_b")
    both = a.join(b, ["scope", "form"]).where("text_a < text_b").drop("form")
    ids = alike.select("scope", "text", "id")
    return (
        both.join(ids.withColumnRenamed("text", "text_a").withColumnRenamed("id", "x"), ["scope", "text_a"])
        .join(ids.withColumnRenamed("text", "text_b").withColumnRenamed("id", "y"), ["scope", "text_b"])
        .select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .where("id_a < id_b")
        .distinct()
    )
