"""Member and file names: natural order, classification, safe output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a name's ending means.
ARCHIVE_SUFFIXES = [".cbz", ".zip", ".cbr", ".rar", ".cb7", ".7z", ".cbt", ".tar"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tif", ".tiff"]
PAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff"]
FAMILIES = {".cbz": "zip", ".zip": "zip", ".cbr": "rar", ".rar": "rar", ".cb7": "7z", ".7z": "7z", ".cbt": "tar", ".tar": "tar"}

UNSAFE = r'[<>:"\\|?*\x00-\x1f]'


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def extension(name: Column) -> Column:
    """Ending of a base name with its dot, "" if there is none; leading dots start no ending."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def natural_key(path: Column) -> Column:
    """Sort key by segments, then runs of digits as numbers before text in lower case: array<array<struct<k, n, s>>>."""

    def run(t: Column) -> Column:
        digits = t.rlike(r"^[0-9]")
        number = F.when(digits, t.try_cast("decimal(38,0)"))
        return F.struct(F.when(digits, 0).otherwise(1).alias("k"), F.coalesce(number, F.lit(0).cast("decimal(38,0)")).alias("n"), F.when(digits, "").otherwise(F.lower(t)).alias("s"))

    return F.transform(F.split(slashed(path), "/"), lambda seg: F.transform(F.regexp_extract_all(seg, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), run))


def kind(name: Column) -> Column:
    """archive, pdf, image or unsupported, by the ending alone."""
    ext = F.lower(extension(name))
    return F.when(ext.isin(ARCHIVE_SUFFIXES), "archive").when(ext == ".pdf", "pdf").when(ext.isin(IMAGE_SUFFIXES), "image").otherwise("unsupported")


def unsupported_reason(name: Column) -> Column:
    ext = F.lower(extension(name))
    return F.when(kind(name) == "unsupported", F.concat(F.lit("unsupported file type "), F.when(ext == "", "(none)").otherwise(ext)))


def family(name: Column) -> Column:
    ext = F.lower(extension(name))
    out = F.lit(None).cast("string")
    for k, v in FAMILIES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def is_page(member: Column) -> Column:
    """A member that should be decoded as a page."""
    path, base = slashed(member), basename(member)
    junk = path.endswith("/") | path.startswith("__MACOSX/") | base.startswith("._") | (base == "Thumbs.db")
    return ~junk & F.lower(extension(base)).isin(PAGE_SUFFIXES)


def is_comicinfo(member: Column) -> Column:
    return F.lower(basename(member)) == "comicinfo.xml"


def safe_segment(seg: Column) -> Column:
    """A path segment that can be created anywhere; one that had to change carries a digest of what it was."""
    clean = lambda c: F.rtrim(F.regexp_replace(c, UNSAFE, "_"), F.lit(". "))
    a, b = stem(seg), extension(seg)
    same = (clean(a) == a) & (clean(b) == b) & (clean(a) != "")
    digest = F.substring(F.sha2(seg, 256), 1, 8)
    return F.when(same, seg).otherwise(F.concat(F.when(clean(a) == "", "_").otherwise(clean(a)), F.lit("-"), digest, clean(b)))


def translated(name: Column) -> Column:
    """Output name of a file: its stem, "_translated", its ending."""
    return F.concat(stem(name), F.lit("_translated"), extension(name))


def delivered_container(name: Column) -> Column:
    """Output name of a container: RAR is written as zip, PDF as PDF."""
    ext = F.lower(extension(name))
    return F.concat(stem(name), F.lit("_translated"), F.when(ext.isin(".cbr", ".rar"), ".cbz").when(ext == ".pdf", ".pdf").otherwise(extension(name)))


def member_destination(member: Column) -> Column:
    """Where a member's page goes below its item: safe segments, directories kept."""
    segs = F.filter(F.split(slashed(member), "/"), lambda s: ~s.isin("", ".", ".."))
    safe = F.transform(segs, safe_segment)
    folder = F.slice(safe, F.lit(1), F.size(safe) - 1)
    return F.when(F.size(segs) == 0, "page_translated.png").otherwise(F.array_join(F.concat(folder, F.array(translated(F.element_at(safe, -1)))), "/"))


def display_path(path: Column) -> Column:
    """A long-path prefix goes; a UNC one becomes two backslashes."""
    unc, long = "\\\\?\\UNC\\", "\\\\?\\"
    return F.when(path.startswith(unc), F.concat(F.lit("\\\\"), F.substring(path, F.lit(len(unc) + 1), F.length(path)))).when(path.startswith(long), F.substring(path, F.lit(len(long) + 1), F.length(path))).otherwise(path)
