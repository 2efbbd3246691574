"""Bytes to clean text.

UTF-8 without a byte order mark is decoded natively; only other rows cross to
Python, where marks, strict UTF-8, a guess at UTF-16 by its zero bytes, cp1252
and latin-1 are tried in that order.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import text as tx

_MARKS = ((codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))
_INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_GARBLED = re.compile("[\xc0-\xff][\x80-\xff]|[\xc3\xe2].|\xc2|\ufffd")
SCHEMA = "text string, encoding string, replaced boolean, repaired boolean, unicode_normalized boolean, newlines_normalized boolean, controls_stripped long"


@dataclass(frozen=True)
class Decoded:
    text: str
    encoding: str = "utf-8"
    replaced: bool = False
    repaired: bool = False
    unicode_normalized: bool = False
    newlines_normalized: bool = False
    controls_stripped: int = 0

    @property
    def lossy(self) -> bool:
        return bool(self.controls_stripped) or self.replaced

    @property
    def changed(self) -> bool:
        return self.lossy or self.repaired or self.newlines_normalized or self.unicode_normalized


def byte_mark(data: bytes) -> str | None:
    return next((name for mark, name in _MARKS if data.startswith(mark)), None)


def guess_utf16(head: bytes) -> str | None:
    """Which byte order the zero bytes of a sample tell, if there are enough and one side has over twice the other's."""
    even, odd = head[::2].count(0), head[1::2].count(0)
    if even + odd < max(4, len(head) // 64):
        return None
    return "utf-16-be" if even > 2 * odd else "utf-16-le" if odd > 2 * even else None


def garble(text: str) -> int:
    return sum(1 for _ in _GARBLED.finditer(text))


def repair(text: str) -> str:
    """UTF-8 that was read as cp1252, read anew if that leaves less than a third of the garbled pairs."""
    before = garble(text)
    if before:
        try:
            again = text.encode("cp1252").decode()
        except UnicodeError:
            return text
        if 3 * garble(again) < before:
            return again
    return text


def clean(text: str, form: str | None = "NFC", controls: bool = True, **about) -> Decoded:
    """Line ends to LF, control and invisible characters out, Unicode normalised."""
    lf = re.sub("\r\n?", "\n", text)
    kept = lf
    if controls:
        kept = "".join(c for c in lf.translate(_INVISIBLE) if c in "\n\t" or unicodedata.category(c)[0] != "C")
    normal = unicodedata.normalize(form, kept) if form else kept
    return Decoded(normal, controls_stripped=len(lf) - len(kept), newlines_normalized=lf != text, unicode_normalized=normal != kept, **about)


def decode(data: bytes, form: str | None = "NFC", controls: bool = True, mojibake: bool = True) -> Decoded:
    if not data:
        return Decoded("")
    for name in (byte_mark(data), "utf-8", "utf-16?"):
        if name == "utf-16?":
            name = guess_utf16(data[:4096])
        if name:
            try:
                text = data.decode(name)
            except UnicodeDecodeError:
                continue
            # utf-16-le and its kin leave the mark in the text; it is an invisible character
            return clean(text, form, controls, encoding=name)
    try:
        text, name = data.decode("cp1252"), "cp1252"
    except UnicodeDecodeError:
        text, name = data.decode("latin-1"), "latin-1"
    fixed = repair(text) if mojibake else text
    return clean(fixed, form, controls, encoding=name, repaired=fixed != text)


def decoder(form: str | None = "NFC", controls: bool = True, mojibake: bool = True):
    """A pandas function binary -> struct of SCHEMA."""

    @F.pandas_udf(SCHEMA)
    def run(data: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys((p.split()[0] for p in SCHEMA.split(", ")), None)
        rows = pd.DataFrame([empty if d is None else asdict(decode(bytes(d), form, controls, mojibake)) for d in data], columns=list(empty))
        return rows.astype({"controls_stripped": "Int64", "replaced": "boolean", "repaired": "boolean", "newlines_normalized": "boolean", "unicode_normalized": "boolean"})

    return run


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def plain(data: Column) -> Column:
    """Whether the native path gives the same: valid UTF-8, no mark, all ASCII but for nothing that normalisation could change."""
    text = F.try_validate_utf8(data.cast("string"))
    return F.coalesce(text.rlike(r"^[\t\n\r\x20-\x7E]*$"), F.lit(False))


def decode_column(df: DataFrame, content: str = "content", cap: int | None = None) -> DataFrame:
    """df with text and its provenance (fields of SCHEMA, file_bytes, truncated_bytes) in place of ``content``.

    cap: bytes to decode of each row; what is left out is counted, and the caller sees it.
    """
    raw = F.col(content)
    part = F.substring(raw, 1, cap) if cap else raw
    rows = df.withColumns({"file_bytes": F.octet_length(raw).cast("long"), "__part": part}).drop(content)
    rows = rows.withColumn("truncated_bytes", F.col("file_bytes") - F.octet_length("__part"))
    ascii_only = plain(F.col("__part"))
    native = F.col("__part").cast("string")
    # the function is given null for rows of the native path, so their bytes don't travel
    rows = rows.withColumn("__d", decoder()(F.when(~ascii_only, F.col("__part"))))
    lf = tx.newline_norm(native)
    text = F.when(ascii_only, lf).otherwise(F.col("__d.text"))
    fields = {
        "text": text,
        "encoding": F.when(ascii_only, "utf-8").otherwise(F.col("__d.encoding")),
        "had_replacement": F.when(ascii_only, False).otherwise(F.col("__d.replaced")),
        "repaired": F.when(ascii_only, False).otherwise(F.col("__d.repaired")),
        "controls_stripped": F.when(ascii_only, F.lit(0)).otherwise(F.col("__d.controls_stripped")).cast("long"),
        "newlines_normalized": F.when(ascii_only, lf != native).otherwise(F.col("__d.newlines_normalized")),
        "unicode_normalized": F.when(ascii_only, False).otherwise(F.col("__d.unicode_normalized")),
    }
    return rows.withColumns(fields).drop("__part", "__d")
