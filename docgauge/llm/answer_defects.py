"""Broken question and answer pairs and what is wrong with them.

Ordered rules look at the answer, its question and the reference answers:
emptiness, refusal, a question given back, an abrupt end, another language.
Every rule that fires is emitted; the first one is the pair's defect.

The last rule is a script mismatch, and, as one script has many languages, a
model beside it: shares of languages in the uses of frequent words, fitted on
all questions, and fixed function words and endings of further languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.session import cut, discard

#: Ranks of the defects: the first that fires names the pair.
DEFECTS = ("empty", "refusal", "question_copy", "truncated", "other_language")

# --- fixed values ---------------------------------------------------------------

#: Characters that show nothing.
_BLANK = r"[\s ­​-‏ - ⁠﻿]"
#: Words that frame an answer without being one.
_FRAME = r"(?:answer|a|answers?|response|output|antwort|réponse|reponse|respuesta|risposta|ответ|r|null|none|nan)"
#: Phrases that decline or say that there is no answer.
_REFUSALS = {
    "en": r"\b(?:i|we|the model|this model|the system|one)(?:['’]m| am| are| is| was| were)? ?(?:sorry|unable|not able|not sure|not allowed|not permitted)\b"
    r"|\b(?:can ?not|can['’]?t|could not|couldn['’]?t|cannot be|will not|won['’]?t|would rather not|['’]d rather not|refuse to|decline to|unable to|not able to|not possible to|impossible to)\b.{0,24}?\b(?:answer|tell|say|share|help|assist|determine|read|find|identify|provide|verify|extract|state|give|see|make out|comply|disclose|reveal|locate|discern|recognise|recognize|respond|comment|confirm|be (?:read|determined|answered|found|identified))\b"
    r"|^\W*(?:i['’]?m |i am |we are |we['’]re )?sorry\b|\bi (?:do not|don['’]?t) know\b|\bunanswerable\b|\bnot enough (?:information|context|detail)|\binsufficient (?:information|context)"
    r"|\b(?:does not|doesn['’]?t|do not|don['’]?t) (?:contain|include|mention|state|provide|show|say|give|specify)\b"
    r"|\bno (?:such )?(?:answer|information|data|details?) (?:is |are |was |were )?(?:visible|available|given|provided|shown|found|present)|\bthere is no (?:answer|information|such)|^\W*no (?:answer|information|data|details?)\b.{0,60}\b(?:provided|given|available|found|shown|visible|present)\b"
    r"|\btoo (?:blurry|blurred|dark|small|faint) to\b|\bnot legible\b|\billegible\b|\bas an? (?:ai|language model|assistant)\b|\bi must decline\b|\bnot (?:mentioned|stated|specified|given|shown|visible|readable|available|provided)\s*(?:on|in|by|at)?\b[^,;]{0,30}$",
    "fr": r"\bje ne (?:sais|peux|suis|vois|trouve|parviens)\b|\bje n['’]arrive\b|\bdésolée?\b|\bimpossible (?:de|d['’]|à)\s?(?:lire|répondre|dire|trouver|déterminer|identifier|savoir)|\bne (?:contient|mentionne|précise|indique|permet|donne) (?:pas|aucun)|\bpas (?:assez|suffisamment) d['’]informations?|\bn['’]est pas (?:lisible|indiqué|mentionné|précisé|possible)|\baucune (?:réponse|information) (?:n['’]est|visible|disponible)|\billisible\b|\bje refuse\b|\bsans réponse\b",
    "de": r"\b(?:weiß|weiss) (?:ich |es )*nicht\b|\bich weiß (?:es )?nicht\b|\btut mir leid\b|\bkann (?:ich|das|man)\b.{0,40}\bnicht\b|\bich kann\b.{0,60}\b(?:nicht|keine?)\b|\blässt sich\b.{0,50}\bnicht\b|\bnicht (?:lesbar|erkennbar|entnehmen|beantworten|ersichtlich|angegeben|möglich)\b|\bkeine (?:angaben?|informationen?|antwort|auskunft)\b|\bunleserlich\b|\bnicht genug informationen\b",
    "es": r"\bno (?:lo )?sé\b|\blo siento\b|\bno (?:puedo|podemos|es posible|se puede|se pudo|logro)\b|\bno (?:contiene|menciona|indica|incluye|especifica|aparece|figura|muestra)\b.{0,30}\b(?:información|dato|respuesta|respuestas|datos)\b|\bimposible (?:de )?(?:leer|responder|saber|determinar)|\bilegible\b|\bno hay (?:información|respuesta|datos)|\binformación insuficiente\b|\bsin respuesta\b",
    "it": r"\bnon (?:lo )?so\b|\bmi dispiace\b|\bnon (?:posso|possiamo|è possibile|riesco)\b|\bimpossibile (?:leggere|rispondere|determinare)|\billeggibile\b",
    "pt": r"\bnão (?:sei|posso|é possível|consigo)\b|\bdesculpe\b|\bilegível\b",
    "ru": r"\bне (?:знаю|могу|удалось|удаётся)\b|\bизвините\b|\bневозможно\b|\bнет (?:ответа|информации|данных)\b|\bнеразборчиво\b",
}
#: Words after which a phrase must go on.  Not among them are German verbs and
#: separable prefixes, which end clauses.
_OPEN_WORDS = {
    "en": "the a an of and or to in on at by for from with than that which is are was were be been being as has have had will would can could may must its their his her our your this these into per between because since if whether not very",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur par pour avec sans que qui dont est sont a ont était être ce cette ces son sa ses leur chez vers entre plus très ne lorsque pendant depuis",
    "de": "der die das den dem des ein eine einen einem einer eines und oder zum zur im in am für von vom dass sich seine ihre ob weil wenn als wie",
    "es": "el la los las un una unos unas y e o de del al a en con por para sin que es son fue fueron ser se su sus este esta estos estas entre desde hasta como cuando porque más muy lo ha han le",
}
#: Lead-ins that announce an answer.
_LEAD_IN = r"(?:answer is|answer:|is|are|says that|states that|is that|réponse est|antwort lautet|respuesta es|se trata de|il s['’]agit (?:de|du|de la|des)|es handelt sich um|handelt es sich um)"
#: Month names of the four languages, for dates that are cut in the year.
_MONTHS = r"(?:january|february|march|april|may|june|july|august|september|october|november|december|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|januar|februar|märz|juni|juli|oktober|dezember|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
#: Function words that tell languages without training data.
_TELLING = {
    "it": "il lo gli della dello dei degli delle nel nella nei sul sulla per con che è sono stata stato una del al allo alla ai agli alle all da dal dalla dai dell nell sull dall quell sui fra di e ed un non più tra dopo prima anche perché questo questa suo sua ogni molto",
    "pt": "o os uma do dos das em no na nos nas com não que foi são para pelo pela e ou ao um mais depois antes também porque",
    "nl": "het een van en op te voor met niet zijn werd door naar bij uit ook de dat die aan om of maar na",
    "pl": "w na z do nie się jest są oraz dla przez po od za że i",
    "sv": "och att det som en ett av för med på inte är var till från den",
}
#: Scripts whose letters show the language family by themselves.
_SCRIPTS = {"cyrl": r"\p{IsCyrillic}", "grek": r"\p{IsGreek}", "arab": r"\p{IsArabic}", "hebr": r"\p{IsHebrew}", "hani": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", "hang": r"\p{IsHangul}", "deva": r"\p{IsDevanagari}", "thai": r"\p{IsThai}"}

#: Instructions that stand behind a question in a prompt.
_INSTRUCTION = (
    r"^(?:please |bitte |por favor |s il vous plaît )?(?:answer|respond|reply|give|provide|write|use|return|keep|be|antworte|antworten|gib|réponds|répondez|donnez|responda|responde|conteste)\b"
    r".{0,80}\b(?:answer|answers|briefly|brief|concise|word|words|phrase|short|page|text|kurz|wort|antwort|mot|mots|réponse|courte|palabra|palabras|respuesta|breve)\b[^.]{0,20}$"
)

# --- rules as expressions ---------------------------------------------------------


def _plain(c: Column) -> Column:
    """Lower case, one space between words, nothing invisible at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{_BLANK}+", " "))


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(_plain(c), r"[^\p{L}\p{N}]+", " "))


def _references(c: Column) -> Column:
    """The plain references that are not blank."""
    return F.coalesce(F.filter(F.transform(c, _plain), lambda r: r != ""), F.array().cast("array<string>"))


def is_empty(answer: Column, given: Column, references: Column) -> Column:
    """Null, or without a letter, a digit or another sign of an answer, unless a reference is the same."""
    bare = F.regexp_replace(given, r"<[^<>]{0,40}>", " ")
    bare = F.regexp_replace(bare, rf"^\W*{_FRAME}\s*(?:is)?\s*[:：]\W*$", "")
    nothing = ~bare.rlike(r"[\p{L}\p{N}]") | bare.rlike(r"^\W*(?:null|none|nan)\W*$")
    return answer.isNull() | (~F.array_contains(references, given) & nothing)


def refuses(given: Column) -> Column:
    """Whether a plain text declines or says that there is no answer."""
    # one pattern a language: joined into one they lose the search for fixed parts
    patterns = [given.rlike(p) for p in _REFUSALS.values()]
    return reduce(or_, patterns)


def _said(answer: Column) -> Column:
    """The words of an answer without a frame of question and answer marks."""
    given = F.trim(F.regexp_replace(_words_only(answer), r"^(?:q|question|frage|pregunta|domanda|prompt)\s", ""))
    return F.trim(F.regexp_replace(given, r"\s(?:a|answer|antwort|réponse|respuesta)$", ""))


def copies_question(asked: Column, given: Column) -> Column:
    """Whether the answer is the question again, framed or followed by an instruction, and nothing else.

    Both are words only: ``_words_only`` of the question, ``_said`` of the answer.
    """
    tail = F.when(given.startswith(asked), F.trim(given.substr(F.length(asked) + 1, F.length(given) + 1)))
    instruction = tail.rlike(_INSTRUCTION) & ~tail.rlike(r"^answer is\b")
    whole = (tail == "") | instruction | (tail == asked)
    part = asked.startswith(given) & (F.length(given) >= 12) & (F.length(given) >= F.length(asked) * 0.6)
    # a copy with a slip of a letter or two
    most = F.least(F.floor(F.length(asked) / 25).cast("int"), F.lit(4))
    near = (F.abs(F.length(given) - F.length(asked)) <= most) & (F.levenshtein(asked, given, 4) >= 0) & (F.levenshtein(asked, given, 4) <= most)
    return (asked != "") & (F.coalesce(whole, F.lit(False)) | part | near)


def _stem(given: Column) -> Column:
    return F.regexp_replace(given, r"^[\"'(\[{«„“*]+", "")


def breaks_off(answer: Column, given: Column, stem: Column, refs: Column) -> Column:
    """Whether the answer stops before its end; ``stem`` is the plain answer less opening marks."""
    complete = F.array_contains(refs, given)
    marked = given.rlike(r"[\p{L}\p{N},;](?:\s*(?:\.\.\.|…)|[-–—])$") | given.rlike(r"[\p{L}\p{N}][,;]$")
    opening = F.regexp_replace(given, r"[^(\[{«„“]", "")
    closing = F.regexp_replace(given, r"[^)\]}»”]", "")
    quotes = F.length(F.regexp_replace(given, r'[^"]', "")) % 2 == 1
    unclosed = (F.length(F.regexp_replace(opening, r"[«„“]", "")) > F.length(F.regexp_replace(closing, r"[»”]", ""))) | (quotes & given.rlike(r"""(?:^|[\s(])"[^"]*$"""))
    open_words = sorted({w for ws in _OPEN_WORDS.values() for w in ws.split()})
    last = F.regexp_extract(given, r"[\s'’](\p{L}+)$", 1)
    open_end = last.isin(open_words) | given.rlike(rf"\b{_LEAD_IN}\s*:?$")
    open_end = open_end & ~answer.rlike(r"[A-Z]\s*$")
    cut_year = given.rlike(rf"\b{_MONTHS},? (?:\d{{1,2}},? |de |del )?(?:19|20)\d?$") & ~given.rlike(r"\d{4}$")
    cut_amount = given.rlike(r"[$€£]\s?\d{1,3}(?:,\d{3})*,\d{0,2}$")
    # a strict beginning of a reference, not a lone number, not ended by a full stop
    begun = F.exists(refs, lambda r: r.startswith(stem) & (F.length(r) > F.length(stem)) & r.substr(F.length(stem) + 1, F.length(r)).rlike(r"[\p{L}\p{N}]"))
    inside = F.exists(refs, lambda r: r.startswith(stem) & r.substr(F.length(stem) + 1, F.lit(1)).rlike(r"[\p{L}]"))
    beginning = stem.rlike(r"\p{L}") & ~stem.rlike(r"[.!?]$") & begun & (inside | stem.contains(" "))
    parts = F.exists(refs, lambda r: r.startswith(stem) & r.substr(F.length(stem) + 1, F.length(r)).rlike(r"^\s*(?:and|und|et|y|,|;|\(|(?:in|en|im jahr|after|nach|après|después de) \d)"))
    return ~complete & (marked | unclosed | open_end | cut_year | cut_amount | (beginning & (inside | ~parts)))


# --- language ---------------------------------------------------------------------

#: Limits nothing: the language model is fitted on all questions.  The name
#: stays as a test sets it.
TRAINED_QUESTIONS = 20_000

#: Words that open questions, beside the open words above (fixed values).
_ASKING = {
    "en": "what which who whose whom when where why how does did do",
    "fr": "quel quelle quels quelles qui quoi quand où pourquoi combien comment elle il",
    "de": "was welche welcher welches wer wem wen wessen wann wo warum wie viele lautet ist sind über nach aus auf bei mit",
    "es": "qué cuál cuáles quién quiénes cuándo dónde por cuánto cuánta cuántos cuántas cómo está",
}
#: Endings of Italian words that English, French, German and Spanish ones
#: rarely have: plurals in -i, a doubled consonant before the last vowel,
#: participles in -ato and -uto, nouns in -zione, -mento, -ezza, -tà, -tore, -bile.
_ITALIAN = regex.compile(r"(?:[bcdfglmnprstvz]i|([bcdfgmnpstz])\1i?[oai]|[au]t[aeo]|ito|zion[ei]|mento|ezz[ae]|t[àù]|[ìòè]|tor[ei]|gli[aeo]|gn[oai]|sci[ae]|ghe|[ai]bile)$")
_APART = r"[^\p{L}\p{M}]+"
_DATE = regex.compile(rf"\b\d{{1,2}}(?:\.|er|st|nd|rd|th)?\s+(?:de\s+|of\s+)?{_MONTHS}\b(?:\s+de(?:l)?\b)?|\b{_MONTHS}\b(?:\s+\d{{1,2}},)?", regex.IGNORECASE)
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
#: Titles and initialled names (fixed values for the titles).
_NAME = regex.compile(r"\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra)\.?(?:\s+\p{L}\.)*(?:\s+[\p{L}'-]+)?|\b\p{L}\.\s*(?:\p{L}\.\s*)*[\p{L}'-]+", regex.IGNORECASE)
#: Least part of the questions that use a word of the model.
LEAST_USE = 0.0005
#: Least score of another language, and its least lead over that of the question.
LEAST_SCORE, LEAD = 1.0, 1.0


def _among(words: Column, listed: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(listed)))


def fit_languages(pairs: DataFrame) -> dict[str, tuple[tuple[str, float], ...]]:
    """Share of the languages in the uses of a word, for frequent words.

    Counted over every question with an id, one row of it, labelled by the
    function words of the question where one language has most of them; no
    questions give no words.  Only the counts leave the executors: the words
    that are used by ``LEAST_USE`` of the questions are at most the mean number
    of words of a question over ``LEAST_USE``, however many questions there are.
    """
    identified = pairs.where(F.col("question_id").isNotNull())
    each = identified.groupBy("question_id").agg(F.min(F.struct("question", "reference_answers")).alias("row")).select("row.*")
    apart = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), _APART)
    asked = apart(F.col("question"))
    hits = [_among(F.col("asked"), f"{_OPEN_WORDS[k]} {words}".split()) for k, words in _ASKING.items()]
    best = F.array_max("hits")
    label = F.when((best > 0) & (F.size(F.filter("hits", lambda n: n == best)) == 1), F.element_at(F.array(*map(F.lit, _ASKING)), F.array_position("hits", best).cast("int")))
    used = F.array_union("asked", apart(F.array_join("reference_answers", " ")))
    # the empty word stands for the question itself, labelled or not
    words = F.when(F.col("language").isNotNull(), F.array_union(used, F.array(F.lit("")))).otherwise(F.array(F.lit("")))
    labelled = each.withColumn("asked", asked).withColumn("hits", F.array(*hits)).withColumn("language", label)
    uses = labelled.select("language", F.explode(words).alias("word")).groupBy("word")
    counts = cut(uses.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("language") == k).alias(k) for k in _ASKING]))
    questions = sum(r["n"] for r in counts.where(F.col("word") == "").collect())
    least = max(3, round(LEAST_USE * questions))
    rows = counts.where((F.col("word") != "") & (F.col("n") >= least)).collect()
    discard(counts)
    sizes = {k: max(1, sum(r[k] for r in rows)) for k in _ASKING}
    table = {}
    for r in rows:
        rates = {k: r[k] / sizes[k] for k in _ASKING}
        whole = sum(rates.values())
        table[r["word"]] = tuple((k, v / whole) for k, v in rates.items() if v > 0.02 * whole)
    return table


def telling_words() -> dict[str, tuple[str, ...]]:
    """The languages without a model that a function word is of."""
    telling: dict[str, tuple[str, ...]] = {}
    for language, words in _TELLING.items():
        for word in words.split():
            telling[word] = (*telling.get(word, ()), language)
    return telling


def _scores(text: str, table: dict[str, tuple[tuple[str, float], ...]], telling: dict[str, tuple[str, ...]]) -> dict[str, float]:
    """Evidence for each language; names, numbers and dates give none."""
    found: dict[str, float] = {}
    tokens = _TOKEN.findall(_NAME.sub(" ", _DATE.sub(" ", text)))
    if len(tokens) <= 3 and all(t[0].isupper() and not t.isupper() for t in tokens[1:]) and len(tokens) > 1:
        return found  # a name in full
    for token in tokens:
        low = token.lower()
        if len(low) < 2:
            continue
        known = table.get(low)
        for language, share in known or ():
            found[language] = found.get(language, 0.0) + share
        for language in telling.get(low, ()):
            found[language] = found.get(language, 0.0) + 1.0
        if known is None and len(low) > 3 and token[0].islower() and _ITALIAN.search(low):
            found["it"] = found.get("it", 0.0) + 0.5
    return found


def _top(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda k: (scores[k], k)) if scores else None


def strange_language(question: str | None, answer: str | None, references: list[str], table: dict, telling: dict) -> bool:
    """Whether the answer is in a language of neither the question nor a reference."""
    if not answer or not question:
        return False
    given = _scores(answer, table, telling)
    language = _top(given)
    if language is None or given[language] < LEAST_SCORE:
        return False
    home = {_top(_scores(question, table, {}))}
    for r in references:
        if r and (scores := _scores(r, table, telling)):
            top = _top(scores)
            home |= {k for k, v in scores.items() if v >= 0.9 * scores[top]}
    home.discard(None)
    if not home:
        return False
    return language not in home and given[language] >= max(given.get(k, 0.0) for k in home) + LEAD * min(1.0, 0.5 + 0.1 * sum(given.values()))


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``defects``, every defect type that fires, in the order of ``DEFECTS``.

    ``pairs`` has question_id, question, prediction and reference_answers.  A
    null or blank answer is empty whatever the question; null or blank
    references count as none; a null question can be copied by no answer and
    has no language.  Whole texts are read, however long.
    """
    table, telling = fit_languages(pairs), telling_words()
    question, answer, references = F.col("question"), F.col("prediction"), F.col("reference_answers")
    names = pairs.columns
    plain = pairs.withColumns({"__given": _plain(answer), "__refs": _references(references), "__asked": _words_only(question), "__said": _said(answer)})
    plain = plain.withColumn("__stem", _stem(F.col("__given")))
    given, refs = F.col("__given"), F.col("__refs")
    empty = is_empty(answer, given, refs)
    right = F.array_contains(refs, given)  # no reference declines, breaks off or is in a strange language
    refusal = ~right & refuses(given) & ~F.exists(refs, refuses)
    copied = copies_question(F.col("__asked"), F.col("__said"))
    cut_off = breaks_off(answer, given, F.col("__stem"), refs)
    seen = F.concat_ws(" ", question, F.concat_ws(" ", references))
    scripts = [answer.rlike(p) & ~seen.rlike(p) for p in _SCRIPTS.values()]
    script = scripts[0]
    for s in scripts[1:]:
        script = script | s
    script = answer.rlike(r"[\u0370-\u1dff\u2e80-\ud7ff]") & script
    fired = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in zip(DEFECTS, (empty, refusal, copied, cut_off, script))]),
        lambda d: d.isNotNull(),
    )
    ruled = plain.withColumn("defects", fired).withColumn("__right", F.coalesce(right, F.lit(False))).select(*[F.col(f"`{c}`") for c in names if c != "defects"], "defects", "__right")

    def language(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            strange = [
                not ok and "other_language" not in d and strange_language(q, a, [] if r is None else list(r), table, telling)
                for q, a, r, d, ok in zip(batch["question"], batch["prediction"], batch["reference_answers"], batch["defects"], batch.pop("__right"))
            ]
            batch["defects"] = [[*d, "other_language"] if s else list(d) for s, d in zip(strange, batch["defects"])]
            yield batch

    return ruled.mapInPandas(language, ruled.drop("__right").schema)


def defective_questions(pairs: DataFrame, *, delivered: list[str]) -> DataFrame:
    """(question_id, defect_type), one row for each question with a defect.

    A question that was delivered often is judged by the delivery that comes
    first in the order of ``delivered``; null question ids are left out.
    """
    known = pairs.where(F.col("question_id").isNotNull())
    judged = judged_pairs(known).select("question_id", F.struct(*delivered).alias("place"), F.try_element_at("defects", F.lit(1)).alias("defect_type"))
    first = judged.groupBy("question_id").agg(F.min_by(F.struct("defect_type"), "place")["defect_type"].alias("defect_type"))
    return first.where(F.col("defect_type").isNotNull())
