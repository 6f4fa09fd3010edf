"""Scalar text functions as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense: ASCII, no-break and other Unicode spaces, byte order mark.
WIDE_SPACE = "[\\s\\x0B\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
CHUNK_SIZE, CHUNK_OVERLAP = 90, 20
SNIPPET = 240


def collapse(text: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WIDE_SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and _ - . ' becomes a space; single spaces; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_.'-]+", " "))


def clean_token(token: Column) -> Column:
    """Without leading and trailing . ' _ - characters; those inside stay."""
    return F.btrim(token, F.lit(".'_-"))


def normalize_token(token: Column) -> Column:
    return clean_token(F.lower(F.trim(token)))


def split_tokens(normalized: Column) -> Column:
    """Tokens of a normalised text, in order, empty ones dropped."""
    return F.filter(F.transform(F.split(normalized, " "), clean_token), lambda t: t != "")


def tokenize(text: Column) -> Column:
    return split_tokens(normalize_text(text))


def searchable_text(content: Column, *fields: Column) -> Column:
    """Non-blank parts in order, separated by single spaces, trimmed."""
    parts = [F.when(F.trim(x) != "", x) for x in (content, *fields)]
    return F.trim(F.concat_ws(" ", *parts))


def chunk_words(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of overlapping word windows; the first that reaches the end is the last; blank text has none."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and overlap within 0..size-1")
    step = size - overlap
    flat = collapse(text)

    def windows(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / float(step)).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))

    chunks = F.get(F.transform(F.array(F.split(flat, " ")), windows), 0)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.array().cast("array<string>")).otherwise(chunks)


def path_id(path: Column) -> Column:
    """Lower-case id of a path: runs of other characters become one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(path, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path_id(path), F.lit("_chunk_"), index.cast("string"))


def image_id(path: Column) -> Column:
    return F.concat(path_id(path), F.lit("_image"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/\\\\]+$", 0)


# Shown where there is no text.
IMAGE_PLACEHOLDER, TEXT_PLACEHOLDER = "匹配的本地图片。", "该结果没有可显示的文本摘要。"


def snippet(content: Column, data_type: Column | None = None) -> Column:
    """Collapsed text, cut after 240 characters with an ellipsis; a placeholder where it is blank."""
    flat = collapse(content)
    cut = F.when(F.length(flat) <= SNIPPET, flat).otherwise(F.concat(F.substring(flat, 1, SNIPPET), F.lit("…")))
    blank = F.lit(TEXT_PLACEHOLDER) if data_type is None else F.when(data_type == "image", IMAGE_PLACEHOLDER).otherwise(TEXT_PLACEHOLDER)
    return F.when(F.coalesce(flat, F.lit("")) == "", blank).otherwise(cut)


def display_name(file_name: Column, path: Column, id_: Column) -> Column:
    filled = lambda x: F.when(F.trim(x) != "", x)
    return F.coalesce(filled(file_name), filled(base_name(path)), id_)


def display_percent(score: Column) -> Column:
    return F.concat(F.format_number(score * 100, 1), F.lit("%"))


def match_label(by_vector: Column, by_keyword: Column) -> Column:
    return F.when(by_vector & by_keyword, "both").when(by_vector, "vector").otherwise("keyword")


def basic_tokens(text: Column) -> Column:
    """Lower-cased a-z0-9 runs and single other symbols."""
    return F.regexp_extract_all(F.lower(collapse(text)), F.lit("[a-z0-9]+|[^\\sa-z0-9]"), F.lit(0))


def pad_ids(ids: Column, start: int, end: int, pad: int = 0, length: int = 128) -> Column:
    """struct(input_ids, attention_mask, token_type_ids): start, the first length-2 ids, end, padding."""
    kept = F.concat(F.array(F.lit(start)), F.slice(ids, 1, length - 2), F.array(F.lit(end)))
    rest = length - F.least(F.size(ids) + 2, F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), length - rest), F.array_repeat(F.lit(0), rest))
    return F.struct(F.concat(kept, F.array_repeat(F.lit(pad), rest)).alias("input_ids"), mask.alias("attention_mask"), F.array_repeat(F.lit(0), length).alias("token_type_ids"))


def caption_clean_clip(text: Column) -> Column:
    """Input text of the image-text encoder: no replacement characters, six entities (the ampersand first), collapsed."""
    for old, new in (("�", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.lower(collapse(text))


# The split pattern of the image-text encoder.
CLIP_PATTERN = "(?iu)<start_of_text>|<end_of_text>|'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"


def clip_pieces(text: Column) -> Column:
    return F.regexp_extract_all(caption_clean_clip(text), F.lit(CLIP_PATTERN), F.lit(0))


# Patterns of wiki link, template without arguments, heading.
WIKI_LINK, WIKI_TEMPLATE, WIKI_HEADING = r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\{\{[^|}]*\}\}", r"={2,}\s*(.*?)\s*={2,}"


def wiki_clean(text: Column) -> Column:
    """Links keep their label, templates without arguments go, headings lose their marks; trimmed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), WIKI_LINK, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, WIKI_TEMPLATE, ""), WIKI_HEADING, "$1"))


def caption_line(text: Column) -> Column:
    """A caption without newlines (removed, not replaced), trimmed."""
    return F.replace(F.trim(text), F.lit("\n"), F.lit(""))
