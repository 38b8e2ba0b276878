"""Names, paths, sizes and titles as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a name that speak of a copy or a poor version. Fixed values.
SUSPECT_WORDS = ["副本", "copy", "备份", "backup", "重打包", "重新打包", "低清", "压缩版", "自制", "扫描", "扫图", "汉化组", "(1)", "(2)", "(3)", "[1]", "[2]", "temp", "tmp", "old", "旧", "未整理"]
#: Extensions of archives and images. Fixed values.
ARCHIVE_TYPES = ["zip", "cbz", "rar", "cbr", "7z", "cb7"]
IMAGE_TYPES = ["jpg", "jpeg", "jpe", "png", "webp", "bmp", "gif", "tif", "tiff", "avif"]
#: Relations of two books, by whether page numbers agree and page counts are equal. Fixed values.
RELATIONS = {(True, True): "完全相同", (True, False): "页码对齐·两版页数不同", (False, True): "有页码偏移", (False, False): "有页码偏移·两版页数不同"}
#: Bracketed remarks, parts and volume numbers in titles. Fixed values.
BRACKETED = r"[\[\(（【][^\[\]\(\)（）【】]*[\]\)）】]"
PART_WORDS = ["前編", "後編", "前篇", "后篇", "上卷", "中卷", "下卷", "上册", "下册"]
VOLUME_PATTERNS = [r"第\s*(\d+)\s*[卷巻册]", r"[Vv]ol(?:ume)?\.?\s*(\d+)", r"\bCh(?:apter)?\.?\s*(\d+)", r"[_\-\s](\d{1,3})\s*$"]
TITLE_MARKS = r"[\s\-–—~〜+＋、,，。.:：!！?？'\"]+"


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(name), r"[^.]\.([^.]+)$", 1))


def natural_key(name: Column) -> Column:
    """Array of strings that sorts names as people do: letters and numbers in turn, letters first, numbers by value.

    A number is written as its count of digits, then its digits, so that it
    may be of any length.
    """
    base = F.lower(basename(name))
    parts = F.regexp_extract_all(base, F.lit(r"\d+|\D+"), F.lit(0))
    lead = F.when(base.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(p)

    return F.concat(lead, F.transform(parts, part))


def is_page_name(name: Column) -> Column:
    """Whether a member of an archive or folder is a page: an image, neither hidden nor of a resource fork."""
    slashed = F.translate(name, "\\", "/")
    return extension(name).isin(IMAGE_TYPES) & ~slashed.startswith("__MACOSX/") & ~slashed.startswith(".DS_Store") & ~basename(name).startswith(".")


#: First bytes of archive formats. Fixed values.
FORMAT_MARKS = {
    "zip": [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"],
    "rar": [b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"],
    "7z": [b"7z\xbc\xaf\x27\x1c"],
}
#: Formats by extension. Fixed values.
FORMAT_TYPES = {"zip": ["zip", "cbz"], "rar": ["rar", "cbr"], "7z": ["7z", "cb7"]}


def sniffed_format(head: Column) -> Column:
    """zip, rar, 7z or null by the first eight bytes."""
    digits = F.hex(head)
    tried = [F.when(digits.startswith(mark.hex().upper()), kind) for kind, marks in FORMAT_MARKS.items() for mark in marks]
    return F.coalesce(*tried)


def normal_path(path: Column, shares: Mapping[str, str] | None = None) -> Column:
    """A path in its one form: backslashes, a share's drive for the share (longest first, any case), upper-case drive, no trailing backslash."""
    s = F.translate(path, "/", "\\")
    out = s
    for share, drive in sorted((shares or {}).items(), key=lambda x: len(x[0])):
        n = len(share)
        tail = F.substring(F.rtrim(s, F.lit("\\")), n + 1, 1 << 20)
        hit = (F.lower(F.substring(s, 1, n)) == share.lower()) & ((tail == "") | tail.startswith("\\"))
        out = F.when(hit, F.concat(F.lit(drive), F.when(tail == "", F.lit("\\")).otherwise(tail))).otherwise(out)
    out = F.when(out.rlike(r"^[A-Za-z]:"), F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20))).otherwise(out)
    return F.when(F.length(out) > 3, F.rtrim(out, F.lit("\\"))).otherwise(out)


def suspects(name: Column) -> Column:
    """How many of SUSPECT_WORDS a name holds, each once."""
    low = F.lower(name)
    return sum([low.contains(w).cast("int") for w in SUSPECT_WORDS], F.lit(0))


def human_size(n: Column) -> Column:
    """Bytes for people: 12 B, 3.40 KB; '-' for null. Ties round to even."""
    x = n.cast("double")
    told = lambda power, unit: F.format_string(f"%.2f {unit}", F.bround(x / F.lit(1024.0**power), 2))
    out = told(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(x < 1024.0 ** (power + 1), told(power, unit)).otherwise(out)
    return F.when(n.isNull(), "-").when(x < 1024, F.format_string("%.0f B", x)).otherwise(out)


def relation(pages_agree: Column, counts_agree: Column) -> Column:
    return (
        F.when(pages_agree & counts_agree, RELATIONS[True, True])
        .when(pages_agree, RELATIONS[True, False])
        .when(counts_agree, RELATIONS[False, True])
        .otherwise(RELATIONS[False, False])
    )


def title_volume(name: Column) -> Column:
    """Struct (title, volume) of a file name; the first pattern that matches gives the volume, '' if none does."""
    s = F.regexp_replace(name, r"(?<=[^./])\.[^./]*$", "")
    s = F.trim(F.regexp_replace(F.translate(F.regexp_replace(s, BRACKETED, " "), "_　", "  "), r"\s+", " "))
    title, volume = s, F.lit("")
    for pattern in reversed(VOLUME_PATTERNS):
        hit = s.rlike(pattern)
        number = F.regexp_replace(F.regexp_extract(s, pattern, 1), r"^0+(?=\d)", "")
        title = F.when(hit, F.concat(F.regexp_extract(s, f"(?s)^(.*?)(?:{pattern})", 1), F.lit(" "), F.regexp_extract(s, f"(?s)^.*?(?:{pattern})(.*)$", 2))).otherwise(title)
        volume = F.when(hit, number).otherwise(volume)
    for word in reversed(PART_WORDS):
        title = F.when(s.contains(word), F.replace(s, F.lit(word), F.lit(" "))).otherwise(title)
        volume = F.when(s.contains(word), F.lit(word)).otherwise(volume)
    title = F.lower(F.trim(F.regexp_replace(title, TITLE_MARKS, " ")))
    return F.struct(title.alias("title"), volume.alias("volume"))
