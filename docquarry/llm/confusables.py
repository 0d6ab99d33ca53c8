"""Bringing visually identical text to one form (problem 8)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.session import materialise

# Letters of other scripts with the shape of a Latin letter, and that letter.
LOOKALIKES = {
    "CYRILLIC": {
        "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
        "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    },
    "GREEK": {
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
        "α": "a", "ι": "i", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ϲ": "c", "ϳ": "j", "κ": "к", "τ": "т",
    },
    "ARMENIAN": {"Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U", "ց": "g", "հ": "h", "յ": "j", "ո": "n", "օ": "o", "զ": "q", "ս": "u"},
    "CHEROKEE": {
        "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
        "Ꮟ": "b", "Ꮷ": "d", "Ꮒ": "h", "Ꭵ": "i", "Ꭹ": "y",
    },
    "LISU": {
        "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    },
    "COPTIC": {"Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲭ": "X", "ⲥ": "c", "ⲟ": "o", "ⲣ": "p"},
    "LATIN": {"ɑ": "a", "ᴄ": "c", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ʙ": "в", "ĸ": "к", "ᴋ": "к", "ᴍ": "м", "ʜ": "н", "ᴛ": "т", "ᴙ": "я"},
}
# Format characters that are seen although Unicode counts them as formats, line ends among the controls.
SEEN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
LINE_ENDS = "\t\n\v\f\r\x1c\x1d\x1e\x85"
# Characters without width that aren't formats.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


def _points() -> Iterator[int]:
    """Code points that can be affected: all assigned planes but ideographs and syllables, which stand for themselves."""
    for low, high in ((0, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x1F000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        yield from range(low, high)


def single_mapping() -> dict[str, str]:
    """Code point to replacement ('' for characters without width), built from rules and the look-alike tables.

    Wide, narrow, joined and font forms stand for what they are made of; the result of a rule is looked
    up again, so a mathematical alpha ends as the Latin a. Raises ValueError where two rules disagree or
    a replacement would itself be replaced, so that the form is the same however often it is applied.
    """
    out: dict[str, str] = {}

    def add(source: str, target: str) -> None:
        if out.setdefault(source, target) != target:
            raise ValueError(f"{source!r} is mapped to {out[source]!r} and {target!r}")

    letters: dict[str, str] = {}
    for table in LOOKALIKES.values():
        for source, target in table.items():
            if letters.setdefault(source, target) != target or target in letters:
                raise ValueError(f"{source!r} is mapped twice")
            add(source, target)
    for point in _points():
        c = chr(point)
        kind = unicodedata.category(c)
        if c in UNSEEN or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or (kind == "Cf" and c not in SEEN_FORMATS) or (kind == "Cc" and c not in LINE_ENDS):
            add(c, "")
        elif kind == "Zs" and c != " ":
            add(c, " ")
        else:
            how, _, what = unicodedata.decomposition(c).partition(" ")
            name = unicodedata.name(c, "")
            joined = how == "<compat>" and (("LIGATURE" in name and (point < 0x0200 or 0xFB00 <= point <= 0xFB17)) or "ROMAN NUMERAL" in name)
            if joined or how in ("<wide>", "<narrow>", "<font>"):
                add(c, "".join(letters.get(x, x) for x in unicodedata.normalize("NFKD", "".join(chr(int(x, 16)) for x in what.split()))))
    for source, target in out.items():
        if any(x in out for x in target):
            raise ValueError(f"{source!r} becomes {target!r}, which is mapped again")
    return out


class _Outputs(dict):
    """Unit to output; units met for the first time go through the automaton. Bounded."""

    MOST = 200_000

    def __init__(self, run: Callable[[str], str]) -> None:
        self.run = run

    def __missing__(self, unit: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        out = self[unit] = self.run(unit)
        return out


class Transducer:
    """One pass over a text, longest match first: each grapheme cluster is replaced by the automaton's output for it.

    The automaton is compiled once. apart has, for every code point it concerns, the symbols that it
    stands for: nothing for one without width, the look-alike Latin letter, base and marks of a composed
    letter. arcs lead from a letter over a mark to the composed letter; a cluster's marks are taken in
    canonical order and followed as far as arcs lead, the rest stays behind the letter.

    The output of a word waits until its end: a word that also holds letters only one other script has,
    and none only Latin has, is spelled in that script. The rule looks at the outputs alone, so equal
    looks stay equal. Words that were met before are looked up (bounded).
    """

    def __init__(self) -> None:
        single = single_mapping()
        self.order = {chr(c): k for c in _points() if (k := unicodedata.combining(chr(c)))}
        self.apart: dict[str, str] = {}
        self.arcs: dict[tuple[str, str], str] = {}
        for point in _points():
            c = chr(point)
            whole = unicodedata.normalize("NFD", c)
            symbols = "".join(single.get(x, x) for x in (c if c in single else whole))
            if symbols != c:
                self.apart[c] = symbols
            parts = unicodedata.decomposition(c)
            if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", c) == c:
                a, b = (chr(int(x, 16)) for x in parts.split())
                self.arcs[a, b] = c
        # syllables of Hangul are composed by rule
        for lead in range(19):
            for vowel in range(21):
                pair = chr(0xAC00 + (lead * 21 + vowel) * 28)
                self.arcs[chr(0x1100 + lead), chr(0x1161 + vowel)] = pair
                for tail in range(1, 28):
                    self.arcs[pair, chr(0x11A7 + tail)] = chr(ord(pair) + tail)
        self.marks = {c for c in map(chr, _points()) if unicodedata.category(c) in ("Mn", "Mc")} | {c for c, x in single.items() if not x}
        # from a character of interest to the end of what may be its word
        touched = "\\x00-\\x08\\x0e-\\x1b\\x7f-\\U0010ffff"
        self.unit = re.compile(f"[{touched}][A-Za-z0-9_{touched}]*")
        self.back = {script: {latin: other for other, latin in reversed(table.items())} for script, table in LOOKALIKES.items() if script != "LATIN"}
        # letters that are the form of another script's letters prove no script, unless no other does
        self.shared = {latin for table in LOOKALIKES.values() for latin in table.values()}
        self.back["CYRILLIC"] |= {c: c for c in self.shared if c > "Ͱ"}
        self.outputs = _Outputs(lambda unit: self.composed(self.spelled(self.symbols(unit))))

    def symbols(self, unit: str) -> list[str]:
        """What the characters stand for, marks in canonical order."""
        out = list("".join(self.apart.get(c, c) for c in unit))
        order = self.order
        low = 0
        while low < len(out):
            if out[low] not in order:
                low += 1
                continue
            high = low
            while high < len(out) and out[high] in order:
                high += 1
            if high - low > 1:
                out[low:high] = sorted(out[low:high], key=order.__getitem__)
            low = high
        return out

    def composed(self, symbols: list[str]) -> str:
        """Each letter with the marks that arcs lead over, longest match first; the other marks behind it."""
        out: list[str] = []
        base, before = -1, 0
        for x in symbols:
            k = self.order.get(x, 0)
            if base >= 0 and (before < k or before == 0 and len(out) - 1 == base):
                whole = self.arcs.get((out[base], x))
                if whole is not None:
                    out[base] = whole
                    continue
            out.append(x)
            if k:
                before = k
            else:
                base, before = len(out) - 1, 0
        return "".join(out)

    def spelled(self, symbols: list[str]) -> list[str]:
        """The symbols, each word in the one script whose own letters it holds, where that script has all of its letters."""
        if not any(x > "ͯ" for x in symbols):
            return symbols
        out, low = list(symbols), 0
        while low < len(out):
            high = low
            while high < len(out) and (out[high].isalnum() or out[high] == "_" or unicodedata.category(out[high])[0] == "M"):
                high += 1
            letters = [x for x in out[low:high] if x.isalpha()]
            own = [x for x in letters if x > "ͯ"]
            scripts = {unicodedata.name(x, "?").split()[0] for x in own if x not in self.shared} or {"CYRILLIC" for _ in own}
            back = self.back.get(scripts.pop(), {}) if len(scripts) == 1 else {}
            if back and all(x in back for x in letters if x <= "ͯ" or x in self.shared):
                out[low:high] = [back.get(x, x) for x in out[low:high]]
            low = max(high, low + 1)
        return out

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() and text.isprintable():
            return text
        out, done, outputs = [], 0, self.outputs
        for hit in self.unit.finditer(text):
            low, high = hit.span()
            # back to the word's start, or to the base that marks stand on
            start = text.rfind(" ", done, low) + 1 or done
            if start < low and not text[start:low].isalnum():
                start = low
                while start > done and (text[start - 1].isalnum() or text[start - 1] == "_"):
                    start -= 1
            if start == low > done and text[low] in self.marks:
                start -= 1
            out.append(text[done:start])
            out.append(outputs[text[start:high]])
            done = high
        out.append(text[done:])
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """One per Python worker."""
    return Transducer()


@F.pandas_udf(T.StringType())
def _one_form(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    form = transducer()
    for texts in parts:
        yield texts.map(form, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _form_print(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    form = transducer()
    for texts in parts:
        yield texts.map(lambda t: hashlib.md5(form(t).encode("utf-8", "surrogatepass")).digest(), na_action="ignore")


def one_form(text: Column) -> Column:
    """The consistent form of a text: null stays null, empty stays empty; whole texts, whatever their length.

    Full-width and joined forms, accents composed or not, characters without width, kinds of blank and
    look-alike letters are unified. Letter case, digits, punctuation, accents, the number of blanks,
    tabs and line breaks stay.
    """
    return _one_form(text)


def form_print(text: Column) -> Column:
    """128-bit fingerprint of one_form(text), without moving the form out of the worker; null for null."""
    return _form_print(text)


def lookalike_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ in code points and have the same form.

    Null and empty texts are no case; rows repeated under one id count once; other columns aren't
    read; an empty table gives none. Only groups that hold two different texts are joined, on the
    fingerprint of their form, so copies of one text meet no one but texts that differ from it.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(row_id).alias("id"), form_print(F.col(text)).alias("form"), F.unhex(F.md5(F.col(text))).alias("stored"))
    rows = materialise(rows, "forms")
    mixed = rows.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("form")
    kept = rows.join(mixed, "form", "left_semi").distinct()
    a, b = (kept.select("form", F.col("id").alias(f"id_{x}"), F.col("stored").alias(f"stored_{x}")) for x in "ab")
    return a.join(b, "form").where("id_a < id_b and stored_a <> stored_b").select("id_a", "id_b").distinct()
