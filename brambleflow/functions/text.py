"""Text expressions: tokens, salvage of JSON, intents and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the token pattern; everything else separates.
TOKEN = "[a-z0-9]+"


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def item_text(title: Column, brand: Column, category: Column, description: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, brand, category, description))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(filled(c) for c in columns))


def first_words(c: Column, n: int, default: str) -> Column:
    """The first n words, or a default where there is none."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(text == "", F.lit(default)).otherwise(F.array_join(F.slice(F.split(text, " "), 1, n), " "))


def salvaged_json(c: Column) -> Column:
    """The text of the first JSON object: code fences taken off, else from the first brace to the last; null where none parses."""
    plain = F.trim(F.regexp_replace(c, r"(?m)^```.*$", ""))
    inner = filled(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    good = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.startswith(x, F.lit("{")), x)
    return F.coalesce(good(plain), good(inner))


def intent_fields(json: Column, query: Column) -> dict[str, Column]:
    """Category, attributes, occasion and query of an intent, with their fallbacks."""
    get = lambda path: filled(F.get_json_object(json, path))
    return {
        "category": F.coalesce(get("$.category"), F.lit("")),
        **{a: F.coalesce(get(f"$.attributes.{a}"), F.lit("")) for a in ("color", "material", "pattern", "style", "fit")},
        "occasion": F.coalesce(get("$.occasion"), F.lit("")),
        "enhanced_query": F.coalesce(get("$.enhanced_query"), first_words(query, 8, "fashion")),
    }


def search_string(enhanced: Column, category: Column, attributes: list[Column], occasion: Column) -> Column:
    """The enhanced query, else category, attributes and two words of the occasion."""
    parts = F.concat_ws(" ", filled(category), *(filled(a) for a in attributes), filled(first_words(occasion, 2, "")))
    return F.coalesce(filled(F.trim(enhanced)), parts)


def hashed_vector(c: Column, size: int) -> Column:
    """A native stand-in for a text encoder: counts of tokens by hash, of length one; null without tokens."""
    from .vectors import normalized

    buckets = F.transform(tokens(c), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size)
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), size), lambda v, b: F.transform(v, lambda x, i: x + (i == b).cast("double")))
    return F.when(F.size(buckets) > 0, normalized(counts))


def tag_display(tag: Column, names: dict[str, str], keywords: dict[str, list[str]]) -> Column:
    """A tag's display name: its own, else that of the last tag with it as a keyword, else itself."""
    reverse = {word.lower(): t for t, words in keywords.items() for word in words}
    literal = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    return F.coalesce(literal(names)[tag], literal(reverse)[F.lower(tag)], tag)


def reason_pills(tags: Column, personalization: Column, negative: Column) -> Column:
    """Up to three reasons: the two best tags of 0.08 or more (structs of tag and score), gain over 0.12, loss over 0.18."""
    best = F.slice(F.filter(tags, lambda x: x["score"] >= 0.08), 1, 2)
    matched = F.when(F.size(best) > 0, F.concat(F.lit("matches "), F.array_join(F.transform(best, lambda x: x["tag"]), " / ")))
    hundredths = lambda c: F.floor(c * 100 + 0.5)
    shown = lambda c: F.format_string("%d.%02d", F.floor(hundredths(c) / 100), hundredths(c) % 100)
    gain = F.when(personalization > 0.12, F.concat(F.lit("personalised +"), shown(personalization)))
    loss = F.when(negative > 0.18, F.concat(F.lit("dislikes -"), shown(negative)))
    return F.slice(F.array_compact(F.array(matched, gain, loss)), 1, 3)


def chat_response(category: Column, attributes: list[Column], occasion: Column, found: Column) -> Column:
    """What is said with results: the understood wish and how many items were found."""
    wish = F.concat_ws(" ", filled(F.concat_ws(", ", *(filled(a) for a in attributes))), F.coalesce(filled(category), F.lit("item")))
    purpose = F.when((occasion != "") & (occasion != "general"), F.concat(F.lit(" for "), occasion)).otherwise("")
    result = F.when(found > 0, F.concat(F.lit(" Found "), found.cast("string"), F.lit(" matching items."))).otherwise(F.lit(" Nothing matches; try other words or fewer conditions."))
    return F.concat(F.lit("You are looking for "), wish, purpose, F.lit("."), result)


def url_extension(url: Column) -> Column:
    """The image extension of a URL's path, .jpg where it has none."""
    found = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"(\.(?:jpg|jpeg|png|webp))$", 1)
    return F.coalesce(filled(found), F.lit(".jpg"))


def valid_nickname(c: Column) -> Column:
    """Three characters or more after trimming: letters, digits, _ and -, one letter or digit at least."""
    name = F.trim(c)
    return (F.length(name) >= 3) & name.rlike(r"^[\p{L}\p{N}_-]+$") & name.rlike(r"[\p{L}\p{N}]")


def enhanced_prompt(query: Column) -> Column:
    return F.concat(F.lit("a product photo of "), query, F.lit(", high quality, clean background"))


def display_score(score: Column) -> Column:
    """A cosine shown between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))
