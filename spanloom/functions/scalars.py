"""Scalar functions of timelines: categories, names, formats, lenient parsing; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalised categories, and keywords in order of priority with their category.
CATEGORIES = ("interview", "host", "report", "announcement", "performance", "sports", "introduction", "closing", "credits", "other")
KEYWORDS = (
    ("interview", "interview"), ("q&a", "interview"), ("q and a", "interview"), ("sport", "sports"), ("game", "sports"), ("match", "sports"), ("credit", "credits"),
    ("intro", "introduction"), ("teaser", "introduction"), ("open", "introduction"), ("closing", "closing"), ("outro", "closing"), ("sign-off", "closing"),
    ("sign off", "closing"), ("wrap-up", "closing"), ("wrap up", "closing"), ("announce", "announcement"), ("psa", "announcement"), ("public service", "announcement"),
    ("commercial", "announcement"), ("advert", "announcement"), ("advocacy", "announcement"), ("ad ", "announcement"), ("perform", "performance"), ("music", "performance"),
    ("dance", "performance"), ("performer", "performance"), ("song", "performance"), ("report", "report"), ("field", "report"), ("package", "report"), ("story", "report"),
    ("host", "host"), ("anchor", "host"), ("monologue", "host"), ("narrat", "host"), ("desk", "host"), ("link", "host"),
)
CLOSED_LABELS = ("dance performance", "football game", "tv show", "interview", "political ad", "public service announcement", "music performance")
SYNONYMS = {"public service announcement": "announcement", "psa": "announcement", "commercial": "announcement", "advertisement": "announcement", "q&a": "interview", "music": "performance", "dance": "performance"}
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".ogv", ".ts", ".mts", ".m2ts")
MEDIA_FORMATS = {"mp3": "mp3", "mp4": "mp4", "wav": "wav", "flac": "flac", "ogg": "ogg", "amr": "amr", "webm": "webm", "m4a": "m4a", "mov": "mp4", "qt": "mp4", "m4v": "mp4"}


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded half away from zero on its scaled value, as DuckDB rounds one; Spark's ``round`` goes by the decimals that it prints and takes 1.005 up."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale


def category(text: Column) -> Column:
    """The category of a text: itself, else its first keyword's by priority, else ``other``."""
    r = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(r == "", "other").when(r.isin(*CATEGORIES), r)
    for word, cat in KEYWORDS:
        out = out.when(r.contains(word), cat)
    return out.otherwise("other")


def normalize_category(label: Column, *fallbacks: Column) -> Column:
    """The label's category; if that says nothing, the first fallback text's that does."""
    return F.coalesce(*(F.nullif(category(c), F.lit("other")) for c in (label, *fallbacks)), F.lit("other"))


def title_card(caption: Column) -> Column:
    """Whether a caption looks like a title card: at most 60 characters, 70 % of its letters capitals."""
    c = F.trim(F.coalesce(caption, F.lit("")))
    letters, capitals = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit(r"\p{Lu}"))
    return F.coalesce((F.length(c) <= 60) & (F.try_divide(capitals, letters) >= 0.7), F.lit(False))


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def stem(key: Column) -> Column:
    """The file name without folder and last extension."""
    return F.regexp_replace(basename(key), r"\.[^.]*$", "")


def segment_key(key: Column, prefix: str = "segment") -> Column:
    return F.concat(F.lit(f"{prefix}/"), stem(key), F.lit(".json"))


def extension(key: Column) -> Column:
    return F.regexp_extract(F.lower(key), r"(\.[^./]+)$", 1)


def is_video_file(key: Column) -> Column:
    return extension(key).isin(*VIDEO_EXTENSIONS)


def media_format(uri: Column, default: str | None = None) -> Column:
    """The recogniser's name of a media file's format; ``default`` for others."""
    e = F.regexp_extract(F.lower(uri), r"\.([^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for k, v in MEDIA_FORMATS.items():
        out = out.when(e == k, v)
    return out.otherwise(F.lit(default).cast("string"))


def output_name(name: Column, fallback_stem: Column) -> Column:
    """A safe file name: no folder, no .mp4, no odd characters; else ``<stem>_trimmed.mp4``."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(basename(F.coalesce(name, F.lit(""))), r"(?i)\.mp4$", ""), r"[^A-Za-z0-9._ -]", ""))
    return F.when(F.length(plain) > 0, F.concat(plain, F.lit(".mp4"))).otherwise(F.concat(fallback_stem, F.lit("_trimmed.mp4")))


def original_name(disposition: Column, metadata: Column, key: Column, keys: tuple[str, ...] = ("original-filename", "original_filename", "filename")) -> Column:
    """The upload's file name: from the content disposition, else from metadata, else the key's."""
    named = F.nullif(F.regexp_extract(disposition, r'filename="?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(named, *(F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys), basename(key))


def closed_label(text: Column, categories: tuple[str, ...] = CLOSED_LABELS) -> Column:
    """The first category that holds the text or is held by it (an empty text is the first), else one that shares a word, else ``other``."""
    r = F.lower(F.trim(text))
    out = F.when(F.lit(False), F.lit(""))
    for c in categories:
        out = out.when(r.contains(c) | F.contains(F.lit(c), r), c)
    for c in categories:
        some = F.lit(False)
        for w in c.split():
            some = some | r.contains(w)
        out = out.when(some, c)
    return out.otherwise("other")


def taxonomy_label(label: Column, types: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The first type of a per-timeline taxonomy that holds the label or is held by it; an empty label is ``other``."""
    r = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    direct = F.get(F.filter(types, lambda t: r.contains(F.lower(t)) | F.contains(F.lower(t), r)), F.lit(0))
    out = direct
    for word, means in synonyms.items():
        out = F.coalesce(out, F.when(r.contains(word) & F.array_contains(types, means), F.lit(means)))
    return F.when(r == "", "other").otherwise(F.coalesce(out, F.lit("other")))


def near(t: Column, points: Column, tol: float) -> Column:
    """Whether any point lies within ``tol``."""
    return F.exists(points, lambda p: F.abs(t - p) <= tol)


def json_object(text: Column, schema: str) -> Column:
    """The object from the first { to the last } of a reply; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def reply_lines(text: Column) -> Column:
    """``index / category / description`` lines of a reply, as structs; the last line of an index wins."""
    parts = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d+\s*/")), lambda x: F.split(x, "/", 3))
    rows = F.transform(parts, lambda p, i: F.struct(F.trim(p[0]).cast("int").alias("idx"), i.alias("pos"), closed_label(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("category"), F.substring(F.lower(F.trim(F.coalesce(F.get(p, F.lit(2)), F.lit("")))), 1, 40).alias("description")))
    return F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["idx"] == r["idx"]) & (o["pos"] > r["pos"])))


def salvaged_objects(text: Column, schema: str) -> Column:
    """All complete flat objects of a list that may be cut off, parsed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda x: F.from_json(x, schema)), lambda x: x.isNotNull())


def bullets(items: Column) -> Column:
    """A bulleted prompt of items."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
