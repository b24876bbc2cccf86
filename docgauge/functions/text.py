"""Text rules of answer scoring, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.split`` sees it; no zero-width space.
_SPACE = r"(?U)[\s\x1c-\x1f\x85]+"


def normalize(text: Column) -> Column:
    """Trimmed lower case with single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), _SPACE, " "))


def strip(text: Column) -> Column:
    """White space cut at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def optional_id(value: Column) -> Column:
    """Trimmed id; blank means missing."""
    return F.nullif(strip(value), F.lit(""))


def valid_references(references: Column) -> Column:
    """Original references, in order, without null and blank ones."""
    return F.coalesce(F.filter(references, lambda r: r.isNotNull() & (normalize(r) != "")), F.array().cast("array<string>"))


def first_valid(answers: Column) -> Column:
    """The first non-blank answer, stripped; null if there is none."""
    return F.try_element_at(F.filter(F.transform(answers, strip), lambda a: a != ""), F.lit(1))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _normal_references(references: Column) -> Column:
    return F.coalesce(F.filter(F.transform(references, normalize), lambda r: r != ""), F.array().cast("array<string>"))


def similarities(prediction: Column, references: Column) -> Column:
    """struct(strict, inclusive, raw_length): the best similarity over the references, by three rules.

    The edit distance of the normalised texts is computed once a reference.
    *strict*: a distance of half the longer text or more scores 0; *inclusive*:
    a similarity of exactly a half counts; *raw_length*: the same distance over
    the longer raw upper-case length.  Texts are normalised once; equal ones,
    and lengths too far apart to reach a half by any rule, need no distance.
    """
    raw = F.coalesce(prediction, F.lit(""))

    def over(p: Column) -> Column:
        def measured(r: Column) -> Column:
            longest = F.greatest(F.length(r["text"]), F.length(p["text"]))
            widest = F.greatest(r["chars"], p["chars"], longest)
            far = 2 * F.abs(F.length(r["text"]) - F.length(p["text"])) > widest
            distance = F.when(r["text"] == p["text"], F.lit(0)).when(far, widest).otherwise(F.levenshtein(r["text"], p["text"]))
            return F.struct(distance.alias("distance"), longest.alias("longest"), F.greatest(r["chars"], p["chars"]).alias("widest"))

        def shares(found: Column) -> Column:
            near = F.array_min(F.transform(found, lambda m: F.least(F.lit(1.0), m["distance"] / m["longest"])))
            raw_near = F.array_min(F.transform(found, lambda m: m["distance"] / m["widest"]))
            return F.struct(F.coalesce(near, F.lit(1.0)).alias("near"), F.coalesce(raw_near, F.lit(1.0)).alias("raw"))

        texts = F.transform(valid_references(references), lambda r: F.struct(normalize(r).alias("text"), F.length(F.upper(r)).alias("chars")))
        return bind(F.transform(texts, measured), shares)

    given = F.struct(normalize(raw).alias("text"), F.length(F.upper(raw)).alias("chars"))
    zero = F.lit(0.0)
    return bind(
        bind(given, over),
        lambda s: F.struct(
            F.when(s["near"] < 0.5, 1.0 - s["near"]).otherwise(zero).alias("strict"),
            F.when(1.0 - s["near"] >= 0.5, 1.0 - s["near"]).otherwise(zero).alias("inclusive"),
            F.when(1.0 - s["raw"] >= 0.5, 1.0 - s["raw"]).otherwise(zero).alias("raw_length"),
        ),
    )


def strict_similarity(prediction: Column, references: Column) -> Column:
    return similarities(prediction, references)["strict"]


def inclusive_similarity(prediction: Column, references: Column) -> Column:
    return similarities(prediction, references)["inclusive"]


def raw_length_similarity(prediction: Column, references: Column) -> Column:
    return similarities(prediction, references)["raw_length"]


def exact(prediction: Column, references: Column) -> Column:
    """Normalised equality with any valid reference; punctuation counts."""
    p = normalize(F.coalesce(prediction, F.lit("")))
    return F.array_contains(_normal_references(references), p).cast("double")


def without_period(text: Column) -> Column:
    """Normalised text less one full stop at its end."""
    return F.regexp_replace(normalize(text), r"\.$", "")


def exact_without_period(prediction: Column, references: Column, *, keep_blank: bool = False) -> Column:
    """Equality that overlooks one final full stop on either side.

    ``keep_blank``: blank references take part, so a blank answer can match.
    """
    p = without_period(F.coalesce(prediction, F.lit("")))
    refs = F.coalesce(F.filter(references, lambda r: r.isNotNull()), F.array().cast("array<string>")) if keep_blank else valid_references(references)
    return F.exists(refs, lambda r: without_period(r) == p).cast("double")


def ends_with_period(text: Column) -> Column:
    return F.coalesce(text.endswith("."), F.lit(False))


def contained_either_way(prediction: Column, references: Column) -> Column:
    """Whether the answer holds a valid reference or the other way round; an empty answer is held by any."""
    p = normalize(F.coalesce(prediction, F.lit("")))
    return F.exists(valid_references(references), lambda r: normalize(r).contains(p) | p.contains(normalize(r)))


def error_tag(prediction: Column, references: Column) -> Column:
    """formatting, partial or content: the first that explains a miss."""
    p = normalize(F.coalesce(prediction, F.lit("")))
    refs = valid_references(references)
    spaceless = F.regexp_replace(p, " ", "")
    formatting = F.exists(refs, lambda r: (without_period(r) == without_period(p)) | (F.regexp_replace(normalize(r), " ", "") == spaceless))
    partial = (p != "") & F.exists(refs, lambda r: normalize(r).contains(p) | p.contains(normalize(r)))
    return F.when(formatting, "formatting").when(partial, "partial").otherwise("content")


# The tags of a miss, by what explains its text and by whether its image was opened.
TEXT_TAGS = {"formatting": "formatting_difference", "partial": "possible_partial_span_or_entity_uncertain", "content": "content_mismatch_string_level"}
IMAGE_TAGS = {True: "image_opened_no_ocr_layout_tooling", False: "image_not_inspected"}
LAST_TAG = "descriptive_only"


def error_tags(prediction: Column, references: Column, opened: Column) -> Column:
    """All tags of a miss: what it is by its text, whether its image was ``opened``, and that nothing more is claimed."""
    kind = error_tag(prediction, references)
    by_text = F.coalesce(*[F.when(kind == k, tag) for k, tag in TEXT_TAGS.items()])
    image = F.when(F.coalesce(opened, F.lit(False)), IMAGE_TAGS[True]).otherwise(IMAGE_TAGS[False])
    return F.array(by_text, image, F.lit(LAST_TAG))


def prompt(question: Column, instruction: str) -> Column:
    return F.concat_ws("\n", strip(question), F.lit(instruction))


def cut_at(prediction: Column, separator: str) -> Column:
    """The answer before the first separator, stripped."""
    return strip(F.substring_index(prediction, separator, 1))


def echoes_prompt(prediction: Column, question: Column) -> Column:
    return F.coalesce(normalize(prediction).contains(normalize(question)) & (normalize(question) != ""), F.lit(False))


def json_document(text: Column, schema: str, required: list[str]) -> Column:
    """The parsed document, or null where it is not one whole object with the required keys."""
    whole = strip(text)
    parsed = F.from_json(whole, schema, {"mode": "PERMISSIVE"})
    complete = whole.rlike(r"(?s)^\{.*\}$")
    for key in required:
        complete = complete & parsed[key].isNotNull()
    return F.when(complete, parsed)
