"""What is found in the bytes of files: kinds by their first bytes, printable strings, and Android binary XML."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First bytes (at an offset) of kinds of files, the longer before the shorter.
MAGIC = (
    ("image/jpeg", 0, "FFD8FF"), ("image/png", 0, "89504E470D0A1A0A"), ("image/gif", 0, "474946"), ("image/webp", 8, "57454250"), ("image/heic", 4, "6674797068656963"),
    ("image/bmp", 0, "424D"), ("image/tiff", 0, "49492A00"), ("image/tiff", 0, "4D4D002A"), ("image/vnd.adobe.photoshop", 0, "38425053"), ("image/x-icon", 0, "00000100"),
    ("video/mp4", 4, "667479706D703432"), ("video/mp4", 4, "6674797069736F6D"), ("video/3gpp", 4, "66747970336770"), ("video/quicktime", 4, "6674797071742020"), ("video/x-matroska", 0, "1A45DFA3"),
    ("video/x-msvideo", 8, "415649"), ("video/x-flv", 0, "464C5601"), ("audio/mpeg", 0, "494433"), ("audio/mpeg", 0, "FFFB"), ("audio/m4a", 4, "667479704D3441"), ("audio/ogg", 0, "4F676753"),
    ("audio/x-flac", 0, "664C6143"), ("audio/x-wav", 8, "57415645"), ("audio/amr", 0, "2321414D52"), ("audio/midi", 0, "4D546864"),
    ("application/zip", 0, "504B0304"), ("application/gzip", 0, "1F8B08"), ("application/x-bzip2", 0, "425A68"), ("application/x-xz", 0, "FD377A585A00"), ("application/x-7z-compressed", 0, "377ABCAF271C"),
    ("application/x-rar-compressed", 0, "526172211A07"), ("application/x-tar", 257, "7573746172"), ("application/pdf", 0, "25504446"), ("application/rtf", 0, "7B5C727466"),
    ("application/x-sqlite3", 0, "53514C69746520666F726D6174203300"), ("application/x-executable", 0, "7F454C46"), ("application/dex", 0, "6465780A"), ("application/msword", 0, "D0CF11E0A1B11AE1"),
    ("font/woff", 0, "774F4646"), ("font/woff2", 0, "774F4632"), ("font/ttf", 0, "0001000000"), ("font/otf", 0, "4F54544F00"),
)


def mime_type(content: Column) -> Column:
    """The kind of a file by its first bytes; null if none is known."""
    found = None
    for kind, at, magic in MAGIC:
        fits = F.substring(content, at + 1, len(magic) // 2) == F.unhex(F.lit(magic))
        found = F.when(fits, kind) if found is None else found.when(fits, kind)
    return found


def printable_strings(files: DataFrame, least: int = 4) -> DataFrame:
    """(path, pos, value): runs of printable ASCII in ``content``, each once for a file, in the order of first sight."""
    text = F.decode("content", "ISO-8859-1")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0)))
    return files.select("path", F.posexplode(runs).alias("pos", "value"))


ABX = b"ABX\0"


@F.pandas_udf(T.StringType())
def binary_xml(contents: pd.Series) -> pd.Series:
    """Android binary XML as XML text; null for other content."""
    return contents.map(xml_text)


def xml_text(content: bytes | None) -> str | None:
    if content is None or content[:4] != ABX:
        return None
    at, names, out, open_tag = 4, [], [], False

    def take(fmt: str):
        nonlocal at
        value = struct.unpack_from(">" + fmt, content, at)[0]
        at += struct.calcsize(">" + fmt)
        return value

    def text() -> str:
        nonlocal at
        n = take("H")
        at += n
        return content[at - n : at].decode("utf-8", "replace")

    def interned() -> str:
        i = take("H")
        if i == 0xFFFF:
            names.append(text())
            return names[-1]
        return names[i]

    def blob() -> bytes:
        nonlocal at
        n = take("H")
        at += n
        return content[at - n : at]

    def escape(value: str) -> str:
        return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    # the upper half of a token byte is the type of its value, the lower half what it is
    values = {1: lambda: "", 2: text, 3: interned, 4: lambda: blob().hex(), 5: lambda: blob().hex(), 6: lambda: str(take("i")), 7: lambda: f"{take('i'):x}", 8: lambda: str(take("q")), 9: lambda: f"{take('q'):x}", 10: lambda: str(take("f")), 11: lambda: str(take("d")), 12: lambda: "true", 13: lambda: "false"}
    try:
        while at < len(content):
            token = take("B")
            what, kind = token & 0x0F, token >> 4
            if what == 15:
                name = interned()
                out.append(f' {name}="{escape(values[kind]())}"')
                continue
            value = values[kind]() if kind else ""
            if open_tag:
                out.append(">")
                open_tag = False
            if what == 2:
                out.append(f"<{value}")
                open_tag = True
            elif what == 3:
                out.append(f"</{value}>")
            elif what in (4, 5, 7):
                out.append(escape(value))
            elif what == 1:
                break
    except (struct.error, IndexError, KeyError):
        return None
    return "".join(out)
