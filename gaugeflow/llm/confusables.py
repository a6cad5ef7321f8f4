"""One consistent form of texts that look the same but differ in their characters.

Every letter that can be mistaken for another belongs to a class of look-alikes, named by its ASCII letter. The classes come
from the published confusables data, the script sets of letters from the published script extensions, both read on the
driver from the ICU library that Spark brings (its versions are in Confusables.version). A text is first taken to classes
(accents apart, invisible characters gone, blanks and width forms unified). Each token is then spelled in the script that
all its classes have a letter for; where several scripts would do (a whole-script confusable), the nearest token that
leaves no choice decides. All of this depends on the classes only, so texts that look the same get the same form.

Differences from the published data, which is made for warnings: letters of one script are never one class (readers of
it tell them apart: I and l, omicron and sigma, i and the dotless one), nor are letters and digits, nor the two cases; of
several letters of a script that look like one, that whose other case does so too stands for it, then the first. Scripts
that words mix as a rule (Han and kana, Hangul) keep their letters. Width and font variants count as the letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.columns import need
from gaugeflow.session import materialize

#: Characters that look like the one given, where the rules below don't say so.
ALIKE = {"Ү": "Y", "Ӏ": "I", "ӏ": "l", "ɡ": "g", "ɑ": "a", "µ": "μ", "ǃ": "!", "ǀ": "|", "‐": "-", "‑": "-", "․": ".", "‚": ",", "ʼ": "’"}
#: Line breaks and blanks among the control characters.
CONTROLS = {"\u0085": "\n", "\u2028": "\n", "\u2029": "\n", "\t": " "}
#: Ranges of characters that show nothing.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))
#: Scripts that are mixed within words.
MIXED_SCRIPTS = frozenset(("Hani", "Hira", "Kana", "Hang", "Bopo", "Jamo", "Yiii", "Tang", "Nshu", "Kits"))

_TOKEN = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f])+")
_CASES = {"Lu": "U", "Ll": "l"}


def _case(c: str) -> str:
    return _CASES.get(unicodedata.category(c), "")


@dataclass(frozen=True)
class Confusables:
    """Classes of look-alikes; see the module's text. Made once by confusables(), sent to executors with the functions."""

    version: str
    #: Code point to the text that stands for its class; None: nothing.
    table: dict[int, str | None]
    #: Class to script to the letter it has for the class.
    letters: dict[str, dict[str, str]]
    #: Letter to its scripts, for all scripts that have a letter of some class.
    scripts: dict[str, frozenset[str]]
    #: Script to classes whose letter belongs to the alphabet of the script's main language.
    usual: dict[str, frozenset[str]]

    @cached_property
    def _classed(self) -> frozenset[str]:
        """Characters that have a class, marks, and letters of scripts that look like Latin in part."""
        return frozenset([*map(chr, self.table), *map(chr, range(0x300, 0x370)), *self._other])

    @cached_property
    def _other(self) -> frozenset[str]:
        return frozenset(c for c, s in self.scripts.items() if "Latn" not in s)

    @cached_property
    def _choices(self) -> dict[str, frozenset[str]]:
        """Letter or class to the scripts it can be spelled in."""
        return self.scripts | {c: frozenset(by) for c, by in self.letters.items()}

    @cached_property
    def _spelling(self) -> dict[str, dict[int, str]]:
        out: dict[str, dict[int, str]] = defaultdict(dict)
        for c, by in self.letters.items():
            for script, letter in by.items():
                if letter != c:
                    out[script][ord(c)] = letter
        return dict(out)

    def token_scripts(self, classes: str) -> frozenset[str]:
        """Scripts in which every class of the token has a letter; empty: none has all (a real mixture)."""
        out = None
        for c in set(classes):
            can = self._choices.get(c)
            if can is not None:
                out = can if out is None else out & can
        return frozenset(("Latn",)) if out is None else out

    def _spell(self, classes: str, whole: str | None) -> str:
        """Tokens in a script that has all their classes; see consistent()."""
        tokens = [(m.start(), m.end(), self.token_scripts(m[0])) for m in _TOKEN.finditer(classes)]
        sure = [(n, next(iter(can))) for n, (a, z, can) in enumerate(tokens) if len(can) == 1 and z - a > 1]  # a lone letter may be a symbol
        out, at, s = [], 0, 0
        for n, (a, z, can) in enumerate(tokens):
            script = next(iter(can)) if len(can) == 1 else "Latn"
            if len(can) > 1 and not whole and sure:
                while s + 1 < len(sure) and sure[s + 1][0] <= n:
                    s += 1
                near = min(sure[s : s + 2], key=lambda x: abs(x[0] - n))[1]
                script = near if near in can and near != "Latn" and all(c in self.usual[near] for c in classes[a:z] if c in self.letters) else "Latn"
            if script != "Latn" and script in self._spelling:
                out += [classes[at:a], classes[a:z].translate(self._spelling[script])]
                at = z
        return "".join([*out, classes[at:]])

    def consistent(self, text: str, whole: str | None = None) -> str:
        """The consistent form of a text.

        A token that could be wholly of another script is spelled as the nearest token of two letters or more that
        couldn't (of two as near, the one before), if its letters are usual in that script, else in Latin; whole='Latn' spells it in Latin wherever it
        stands, for comparing words out of their context.
        """
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if text.isascii():
            return text.replace("\t", " ")
        if self._classed.isdisjoint(set(text)):
            return unicodedata.normalize("NFC", text)
        classes = unicodedata.normalize("NFD", text).translate(self.table)
        if not self._other.isdisjoint(set(classes)):
            classes = self._spell(classes, whole)
        return unicodedata.normalize("NFC", classes)

    def _own(self, token: str) -> frozenset[str]:
        """Scripts that have all letters of a token as they stand; empty: it mixes."""
        sets = [self.scripts[c] for c in set(token) if c in self.scripts]
        return frozenset.intersection(*sets) if sets else frozenset(("Latn",))

    def findings(self, text: str, form: str) -> tuple[int, int]:
        """(tokens that mix scripts, tokens wholly of another script than the one they are spelled in by the form)."""
        if text.isascii():
            return 0, 0
        mixed = whole = 0
        for was, now in zip(*(_TOKEN.findall(unicodedata.normalize("NFD", x)) for x in (text, form))):
            own = self._own(was)
            mixed += not own
            whole += bool(own) and not own & self._own(now)
        return mixed, whole


def _ranges(pattern: str) -> Iterable[tuple[int, int]]:
    """Code point ranges of a set as ICU writes it, with everything but ASCII escaped."""
    one = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\\[\]\-]"
    code = lambda x: int(x[2:], 16) if x[:2] in ("\\u", "\\U") else ord(x[-1])
    for m in re.finditer(f"({one})(?:-({one}))?", pattern.strip("[]")):
        yield code(m[1]), code(m[2] or m[1])


_BUILT: dict[int, Confusables] = {}


def confusables(spark: SparkSession) -> Confusables:
    """The classes, built once a JVM from its ICU library."""
    jvm = spark.sparkContext._jvm
    if id(jvm) in _BUILT:
        return _BUILT[id(jvm)]
    icu = jvm.com.ibm.icu
    points = [c for c in range(0x21, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cc") and not 0x3400 <= c <= 0x9FFF and not 0xAC00 <= c <= 0xD7A3]
    looks = dict(zip(map(chr, points), icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(map(chr, points))).split("\n"), strict=True))

    def ranges_of(chars) -> Iterable[tuple[int, int]]:
        return _ranges(icu.text.UnicodeSet().addAll(chars).toPattern(True))  # a set as made keeps the pattern it was made by

    def script_set(code: str) -> Iterable[tuple[int, int]]:
        return ranges_of(icu.text.UnicodeSet(f"[:scx={code}:]"))

    codes = [icu.lang.UScript.getShortName(i) for i in range(icu.lang.UScript.CODE_LIMIT)]
    held = {code: list(script_set(code)) for code in codes if code not in MIXED_SCRIPTS | {"Zyyy", "Zinh", "Zzzz"} and not icu.text.UnicodeSet(f"[:sc={code}:]").isEmpty()}
    scripts_of: dict[str, set[str]] = defaultdict(set)
    for code, ranges in held.items():
        for lo, hi in ranges:
            for c in range(lo, min(hi, 0x1FFFF) + 1):
                if unicodedata.category(chr(c))[0] == "L":
                    scripts_of[chr(c)].add(code)

    by_look: dict[str, list[str]] = defaultdict(list)
    for c, look in looks.items():
        tag = unicodedata.decomposition(c).split(" ")[0]
        if unicodedata.category(c)[0] == "L" and (not tag or tag == "<compat>") and c in scripts_of:
            by_look[look].append(c)
    target: dict[str, str] = {c: x for c, x in ALIKE.items() if c in scripts_of and x.isascii() and x.isalpha()}
    letters: dict[str, dict[str, str]] = {}
    for look, alike in by_look.items():
        ascii_ = {_case(c): c for c in alike if c.isascii()}
        for case, latin in ascii_.items():
            fits: dict[str, list[str]] = defaultdict(list)
            for c in alike:
                if c.isascii() or c in target or "Latn" in scripts_of[c]:
                    continue
                if _case(c) == case or (not _case(c) and latin == (look if look in ascii_.values() else latin) and (len(ascii_) == 1 or latin == look)):
                    for s in scripts_of[c]:
                        fits[s].append(c)
            other = latin.swapcase()
            for s, found in fits.items():
                both = [c for c in found if c.swapcase() != c and looks.get(c.swapcase()) == looks.get(other)]
                best = min(both or found)
                fixed = next((c for c, x in target.items() if x == latin and c in ALIKE and s in scripts_of[c] and latin == "Y"), None)
                best = fixed or best
                letters.setdefault(latin, {"Latn": latin})[s] = best
                target[best] = latin
    table: dict[int, str | None] = {}
    for c in range(0x80, 0x20000):
        kind = unicodedata.decomposition(chr(c)).split(" ")
        if unicodedata.category(chr(c)) == "Zs":
            table[c] = " "
        elif kind[0] in ("<wide>", "<narrow>"):
            table[c] = chr(int(kind[1], 16))
        elif kind[0] == "<font>" or 0x2160 <= c <= 0x217F:
            plain = unicodedata.normalize("NFKD", chr(c))
            table[c] = "".join(target.get(x, x) for x in plain)
    table |= {ord(c): x for c, x in (target | ALIKE | CONTROLS).items()}
    for lo, hi in INVISIBLE:
        table |= dict.fromkeys(range(lo, hi + 1), None)

    used = {s for by in letters.values() for s in by} | {"Latn", "Grek", "Cyrl"}
    usual: dict[str, frozenset[str]] = {}
    for s in used:
        language = icu.util.ULocale.addLikelySubtags(icu.util.ULocale(f"und_{s}")).getLanguage()
        alphabet = {chr(c) for lo, hi in ranges_of(icu.util.LocaleData.getInstance(icu.util.ULocale(language)).getExemplarSet(0, 0)) for c in range(lo, hi + 1)}
        alphabet |= {c.upper() for c in alphabet}
        usual[s] = frozenset(x for x, by in letters.items() if by.get(s) in alphabet)
    scripts = {c: frozenset(s & used) for c, s in scripts_of.items() if s & used}
    version = f"ICU {icu.util.VersionInfo.ICU_VERSION.toString()}, Unicode {icu.lang.UCharacter.getUnicodeVersion().toString()}"
    _BUILT[id(jvm)] = Confusables(version, table, letters, scripts, usual)
    return _BUILT[id(jvm)]


def consistent_text(text: str | Column, forms: Confusables) -> Column:
    """Column: the consistent form of each text; null stays null."""

    @F.pandas_udf(T.StringType())
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(forms.consistent, na_action="ignore")

    return form(text)


def consistent_findings(text: str | Column, forms: Confusables) -> Column:
    """Column (text, mixed, whole): the consistent form of each text and its findings; null text has null and zeros."""

    @F.pandas_udf("text string, mixed int, whole int")
    def found(texts: pd.Series) -> pd.DataFrame:
        shown = [forms.consistent(t) if isinstance(t, str) else None for t in texts]
        counts = [forms.findings(t, s) if s is not None else (0, 0) for t, s in zip(texts, shown)]
        return pd.DataFrame({"text": pd.Series(shown, dtype=object), "mixed": [m for m, _ in counts], "whole": [w for _, w in counts]})

    return found(text)


def look_alikes(documents: DataFrame) -> DataFrame:
    """(doc_id, form, copy): hashes of the consistent form and of the very characters of each text, written once.

    Rows without id or text are left out. An empty text is a text; all texts that show nothing are alike.
    """
    d = need(documents, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    forms = confusables(documents.sparkSession)
    return materialize(d.select("doc_id", F.md5(consistent_text("text", forms)).alias("form"), F.md5("text").alias("copy")), "forms")


def _varied(rows: DataFrame) -> DataFrame:
    """Forms that are written in two ways or more."""
    return rows.groupBy("form").agg(F.min("copy").alias("lo"), F.max("copy").alias("hi")).filter("lo <> hi").select("form")


def same_looking_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): of each document that another looks like in other characters, the smallest id of its
    class and how many such others there are. Ids are unique. Grows with the documents, not with the pairs."""
    rows = look_alikes(documents)
    held = rows.join(_varied(rows), "form", "left_semi")
    copies = held.groupBy("form", "copy").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    whole = copies.groupBy("form").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    linked = copies.join(whole, "form").select("form", "copy", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return held.join(linked, ["form", "copy"]).select("doc_id", "class_id", "n_links")


def same_looking_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts look the same and differ in characters, the smaller id first.

    A text's copies are paired with each copy of the other text, never with each other: the pairs are the result asked
    for and none is left out (same_looking_classes has them in a row each). Ids are unique; a repeated row counts once.
    Only the rows of forms that are written in two ways meet in the join, on 128-bit hashes.
    """
    rows = look_alikes(documents)
    a = rows.join(_varied(rows), "form", "left_semi").dropDuplicates(["form", "copy", "doc_id"])  # placed by form already: no further shuffle
    b = a.select("form", F.col("doc_id").alias("doc_id_b"), F.col("copy").alias("copy_b"))
    pairs = a.withColumnRenamed("doc_id", "doc_id_a").join(b, "form")
    return pairs.filter("copy <> copy_b AND doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
