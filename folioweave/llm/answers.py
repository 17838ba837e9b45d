"""Broken prompt and response pairs: empty, truncated, refusing, copying and other-language answers.

Responses are sorted by text and compared with their neighbours, so that one that only begins another is known as its
shortened version; lengths at which suspiciously many responses stop are found as spikes; rules for copies and refusals
and a word model of the languages follow. The word model is counted over all answers: most answers are in the language
of their question, so a word's languages show in the questions it answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import once_by
from folioweave.llm.ordering import next_in_order
from folioweave.session import cut, forget

# How answers are introduced, what stands for no answer, and what declines one, in six languages.
LABEL = r"(?:(?:the |final |correct |right |my )*answer|(?:die |richtige )*antwort|(?:la |bonne )*réponse|(?:la )?respuesta(?: correcta)?|(?:правильный )?ответ|答案|response|output)"
NOTHING = frozenset("none null nil n/a na nan empty undefined void unknown blank - no_answer aucune keine ninguna нет 无".split()) | {"no answer", "no response", "not available", ""}
REFUSALS = (
    r"\b(?:i|we)(?: am|'m| are|'re)? (?:sorry|afraid|unable|not able|not sure|not allowed|not permitted)\b",
    r"\b(?:i|we) (?:can ?not|can't|could ?n[o']t|do not|don't|must decline|must refuse|won't|will not|would rather not|decline|refuse|have no (?:way|information|access|idea))\b",
    r"\bas an ai\b",
    r"\b(?:can ?not|can't|could not) be (?:determined|answered|inferred|established|known|decided)\b",
    r"\bnot (?:be )?possible to (?:say|tell|answer|determine|know|decide)\b",
    r"\b(?:do|does|did)(?: not|n't) (?:contain|provide|give|mention|include|offer|say|have|state|specify)\b.{0,200}\b(?:information|answer|question|context|detail|this|enough|evidence)",
    r"\bnot enough (?:context|information|evidence|detail)\b",
    r"\binsufficient (?:context|information|evidence|detail)\b|\b(?:text|context|evidence|information|excerpt) (?:is|are) insufficient\b",
    r"\bno (?:way to tell|answer can be|information|relevant)\b",
    r"\bnone of the (?:passages|excerpts|documents|chunks|evidence)\b",
    r"\bunfortunately\b.{0,200}\b(?:not|unable|can't|cannot)\b",
    r"\bje (?:ne (?:peux|sais|suis|dispose|connais)|suis désolé|regrette|m'excuse|refuse)|\bdésolé|ne permet(?:tent)? pas de|impossible de (?:répondre|déterminer|dire|savoir)|ne contien(?:t|nent) pas|pas assez d['e ]|en tant qu(?:e |')(?:modèle|ia|assistant)|\bil n'est pas possible de",
    r"\bich (?:weiß (?:es )?nicht|kann|darf|bin|habe keinen|muss ablehnen|möchte nicht)|\btut mir (?:sehr )?leid|\bleider\b|nicht genügend|nicht genug|lässt sich (?:\w+ ){0,6}nicht|keine ausreichend|reich(?:t|en) (?:\w+ ){0,4}nicht aus|enth(?:ält|alten) (?:\w+ ){0,3}(?:keine|nicht)|(?:kann|können) (?:\w+ ){0,5}nicht (?:beantwort|bestimm|ermittel)|als (?:ki|sprachmodell)",
    r"\bno (?:puedo|sé|lo sé|dispongo|tengo|me es posible|es posible|hay (?:información|suficiente|contexto))\b|\blo siento\b|\blamento\b|no contien(?:e|en)|no (?:se|permite[n]?) (?:puede |es posible )?(?:determinar|responder|saber)|como (?:modelo|ia|asistente)\b|insuficiente",
    r"не (?:могу|знаю|можем|имею|располагаю)|невозможно|извините|простите|к сожалению|нельзя (?:определить|ответить|сказать|установить)|недостаточно|не хватает|не содерж|как (?:ии|языковая модель|ассистент)|отказываюсь",
    r"无法|不知道|不能回答|不能确定|抱歉|对不起|不足以|没有足够|没有提到|未提及|作为.{0,4}(?:人工智能|语言模型|ai)|拒绝回答|信息不足|资料不足|不清楚",
)
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
_LABEL = re.compile(rf"^\W*{LABEL}\s*(?:[:：]|\bis\b|\best\b|\bist\b|\bes\b|是)\s*", re.I)
_LABEL_COLON = re.compile(rf"{LABEL}\s*[:：]\s*", re.I)
_CHOSEN = re.compile(rf"(?:{LABEL}\s*(?:[:：]|is|est|ist|es|是)|option|choice)\s*[*`\"'(]*([A-D])\b", re.I)
_LETTER = re.compile(r"^[\W_]*(?:option\s+)?([A-Da-d])[\W_]*$", re.I)
_LETTER_TEXT = re.compile(r"^\s*(?:option\s+|choice\s+)?[*`\"'(]*([A-D])[)\].:、。*`\"']+\s*(?=\S)", re.I)
_SCAFFOLD = re.compile(r"(?im)^\s*(?:question|evidence|context|options?|choices?|answer|prompt|instructions?|you asked|user|q|frage|pregunta|вопрос|问题|antwort|réponse|respuesta|ответ|答案)\s*[:：]|you asked\s*[:：]")
#: Quoted speech and foreign words; a quote left open is none.
_QUOTES = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"|\([^()]*\)|（[^（）]*）")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = ".!?。！？"
_CLOSERS = "\"'”’»“」』)）*`_]}> \n\t"
PARSED = "pred_id bigint, raw string, core string, kind string, script string, words array<string>, q_script string, q_words array<string>"


def bare(text: str | None) -> str:
    """Letters and digits of a text in lower case, one space between words."""
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower()))


def script(text: str) -> str:
    """'zh', 'ru', 'latin' or '' by the letters that make up most words of a text."""
    han = sum("㐀" <= c <= "鿿" for c in text)
    cyrillic = len(re.findall(r"[Ѐ-ӿ]+", text))
    latin = len(re.findall(r"\b[a-zß-ÿœ][a-zß-ÿœ'’-]*", text))
    if not han + cyrillic + latin:
        return ""
    most = max(han / 2, cyrillic, latin)
    return "zh" if han / 2 == most else "ru" if cyrillic == most else "latin"


def plain_words(text: str) -> list[str]:
    """Words that are not capitalised, so no names, in lower case."""
    return [w.lower() for w in _WORDS.findall(text) if w[0].islower()]


def asking_words(question: str) -> list[str]:
    """The words of a question that can tell its language: its first one and those that are not capitalised, so no names."""
    words = _WORDS.findall(question)
    return [w.lower() for w in (*words[:1], *(w for w in words[1:] if w[0].islower()))]


def empty_answer(raw: str | None) -> bool:
    if raw is None:
        return True
    text = re.sub(r"<[^<>]*>", " ", unicodedata.normalize("NFKC", raw))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cn") or c in "\n\t ")
    label = _LABEL_COLON.match(text.strip(" *_`\"'\n\t"))
    if label:
        text = text.strip(" *_`\"'\n\t")[label.end() :]
    words = re.sub(r"[^\w/\-]+", " ", text).strip(" _-/").lower()
    return words in NOTHING or not re.search(r"\w", words)


def copied(raw: str, question: str | None, options: list | None) -> bool:
    """Whether an answer is the question, or the prompt around it, and nothing more."""
    asked = bare(question).replace(" ", "")
    text = bare(_SCAFFOLD.sub("\n", raw)).replace(" ", "")
    if not asked or not text:
        return False
    if asked not in text:  # part of the question, unless it plainly breaks off, is the question too
        return len(text) >= 0.6 * len(asked) and asked.startswith(text) and not raw.rstrip().endswith(("-", "...", "…"))
    rest = text.replace(asked, "")
    given = [x for x in (bare(o).replace(" ", "") for o in options or [] if o) if x]
    if len(given) > 1 and all(x in rest for x in given):
        for x in sorted(given, key=len, reverse=True):
            rest = rest.replace(x, "", 1)
    return rest in ("", "abcdefgh"[: len(given)]) if len(given) > 1 else not rest


def refusal(raw: str) -> bool:
    """Whether an answer declines, and no answer follows."""
    if _CHOSEN.search(raw):
        return False
    text = re.sub(r"[’‘]", "'", re.sub(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」", " ", raw)).strip(" \"'*`\n\t")
    first = re.split(r"(?<=[.!?。！？])\s*", text, maxsplit=1)[0]
    return bool(_REFUSAL.search(first))


def ending(raw: str, options: list | None) -> tuple[str, str]:
    """(kind, core) of an answer: 'letter'; 'closed' (a sentence that ends, or a whole option); 'cut' (plainly broken off);
    'open' (a sentence without an end); 'phrase' (a bare phrase without an end). core: the text after label and letter."""
    text = raw.rstrip()
    if _LETTER.match(text):
        return "letter", ""
    lines = [x for x in text.split("\n") if x.strip()]
    tail = _LABEL.sub("", lines[-1]) if lines else ""
    found = list(_LABEL_COLON.finditer(lines[-1])) if lines else []
    inner = lines[-1][found[-1].end() :] if found else tail
    if (_LETTER.match(inner) or _LETTER.match(tail)) and (found or tail != lines[-1]):
        return "letter", ""
    if re.match(r"^\W*option\s+[A-D]\W*$", lines[-1], re.I):
        return "letter", ""
    core = inner if len(inner) < len(tail) else tail
    core = _LETTER_TEXT.sub("", core).strip()
    flat = bare(core)
    wholes = {bare(o) for o in options or [] if o}
    if flat and flat in wholes and not text.endswith(("-", "(")):
        return "closed", core
    if re.search(r"(?:\.\.\.|…)[\"'”’»]*$", text) or text.lstrip()[:1] == "{" and text[-1] != "}":
        return "cut", core
    if re.search(r"[,;:，；：、(（\[{“«„「]$|(?<=\w)[-–—]$|\s[-–—]$|[\s(]\"$", text) or not flat:
        return "cut", core
    if text.rstrip(_CLOSERS)[-1:] in _END or text[-1] in _END:
        return "closed", core
    if any(w.startswith(flat) for w in wholes):
        return "cut", core
    first = next((c for c in core if c.isalpha()), "")
    cjk = "㐀" <= first <= "鿿"
    if (first.isupper() and not cjk) or re.search(r"[.!?]\s|[。！？，]", core) or core.count("“") > core.count("”"):
        return "open", core
    return "phrase", core


def parse_answers(predictions: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for pid, question, options, raw in rows.itertuples(index=False):
                options = [o for o in options if isinstance(o, str)] if options is not None else []
                question = question if isinstance(question, str) else ""
                raw = raw if isinstance(raw, str) else None
                core, words, spoken = "", [], ""
                if empty_answer(raw):
                    kind = "empty"
                elif copied(raw, question, options):
                    kind = "copies_question"
                elif refusal(raw):
                    kind = "refusal"
                else:
                    kind, core = ending(raw, options)
                    told = raw.replace(question, " ") if question else raw
                    told = _QUOTES.sub(" ", re.sub(r"(?im)^\s*question\s*[:：].*$", " ", told))
                    told = _LABEL_COLON.sub(" ", _LABEL.sub(" ", told))
                    spoken, words = script(told), plain_words(told)
                out.append((pid, raw, core, kind, spoken, words, script(question), asking_words(question)))
            yield pd.DataFrame(out, columns=["pred_id", "raw", "core", "kind", "script", "words", "q_script", "q_words"])

    return predictions.mapInPandas(run, PARSED)


def word_rates(words: DataFrame) -> DataFrame:
    """(word, rates, whole) from distinct (pred_id, lang, word): the share of each language's texts that have the word."""
    texts = words.groupBy("lang").agg(F.countDistinct("pred_id").alias("texts"))  # one row a language
    rates = words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(texts), "lang").select("word", "lang", (F.col("n") / F.col("texts")).alias("rate"))
    return rates.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "rate"))).alias("rates"), F.sum("rate").alias("whole"))


def likelihoods(words: DataFrame, rates: DataFrame, langs: list[str]) -> DataFrame:
    """(pred_id, n, l_<lang>...): the words known to the model and the text's log likelihood by language, up to a constant."""
    share = lambda x: (F.coalesce(F.col("rates")[x], F.lit(0.0)) + 0.02 * F.col("whole")) / (F.col("whole") * (1 + 0.02 * len(langs)))
    return words.join(rates, "word").groupBy("pred_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.log(share(x))).alias(f"l_{x}") for x in langs])


def answer_defects(predictions: DataFrame, common_words: DataFrame, buckets: int | None = None) -> DataFrame:
    """(pred_id, defect) of each prediction with a defect, at most one each.

    predictions: pred_id, question, options, raw_llm_output; other columns are ignored. Repeated deliveries of a pred_id
    count once, rows with a null pred_id are left out. A null or blank response is `empty`; a null question only rules out
    copies and other languages. common_words (lang, word) gives the questions' language. No rows give none.
    """
    # each part is a query of its own: in one plan the driver would hold the plans, stages and broadcasts of all parts at once
    parsed = cut(parse_answers(once_by(predictions, "pred_id", "question", "options", "raw_llm_output")), "answers")

    # neighbours in the order of their texts: a phrase that only begins the next one is a shortened version of it
    cores = cut(parsed.where("core <> ''").select("core").distinct(), "cores")
    ordered = next_in_order(cores, "core", buckets)
    shorter = ordered.where(F.col("following").startswith(F.col("core")) & (F.length("following") > F.length("core") + 1)).select("core", F.lit(True).alias("begins_other"))

    # lengths at which many more responses stop, without an end, than at the lengths around them: beyond chance, at any size
    unended = parsed.where(F.col("kind").isin("phrase", "open")).groupBy(F.length("raw").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    shifts = unended.select(F.col("n"), F.explode(F.sequence(F.col("len") - 5, F.col("len") + 5)).alias("len"), F.col("len").alias("own"))
    around = shifts.where("own <> len").groupBy("len").agg((F.sum("n") / 10).alias("near"))
    spikes = unended.join(around, "len", "left").where((F.col("n") > 6 * F.coalesce("near", F.lit(0.0))) & (F.col("n") > F.coalesce("near", F.lit(0.0)) + 6 * F.sqrt(F.coalesce("near", F.lit(0.0)) + 1))).select("len", F.lit(True).alias("spike"))

    # phrases have no end of their own: begun versions of others, stopped at a spike, or with a last word that occurs whole
    # inside no answer are truncated
    last = F.element_at(F.split(F.lower("core"), r"[^\p{L}\p{N}'’-]+"), -1)
    phrases = cut(parsed.where("kind = 'phrase'").select("pred_id", "core", F.length("raw").alias("len"), last.alias("last")), "phrases")
    tokens = parsed.where(F.col("kind").isin("phrase", "open", "closed")).select("kind", F.split(F.lower("core"), r"[^\p{L}\p{N}'’-]+").alias("w"))
    whole = tokens.select(F.explode(F.when(F.col("kind") == "closed", F.col("w")).otherwise(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("last"))
    inside = whole.join(phrases.select("last").distinct(), "last", "left_semi").distinct().withColumn("known", F.lit(True))
    begun = phrases.join(shorter, "core", "left").join(F.broadcast(spikes), "len", "left").join(inside, "last", "left")  # at most one spike a length
    begun = begun.where("begins_other OR spike OR known IS NULL AND NOT core RLIKE '[\\u3400-\\u9fff]'").select("pred_id", F.lit(True).alias("begun"))
    begun = cut(begun, "begun")
    forget(cores), forget(phrases)

    # languages: how often each word is in questions, then in answers to questions, of each language
    common = F.broadcast(common_words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", F.lower("word").alias("word")).distinct())  # a fixed list
    langs = sorted(r.lang for r in common_words.select("lang").where("lang IS NOT NULL AND lang NOT IN ('zh', 'ru')").distinct().collect())
    asked = cut(parsed.where("q_script = 'latin'").select("pred_id", F.explode(F.array_distinct("q_words")).alias("word")), "asked")
    told_words = cut(parsed.where("script = 'latin' AND q_script = 'latin'").select("pred_id", F.explode(F.array_distinct("words")).alias("word")), "told")
    # questions are short, so the answers' common words help to tell which language a word of theirs belongs to
    hits = asked.unionByName(told_words).join(common, "word").groupBy("pred_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    sure = hits.groupBy("pred_id").agg(F.max(F.struct("n", "lang")).alias("best"), F.sort_array(F.collect_list("n"), False).alias("ns")).where("size(ns) = 1 OR ns[0] > ns[1]")
    q_rates = cut(word_rates(asked.join(sure.select("pred_id", F.col("best.lang").alias("lang")), "pred_id")), "rates")
    by_question = likelihoods(asked, q_rates, langs).select("pred_id", *[f"l_{x}" for x in langs])
    ordered_langs = F.sort_array(F.array(*[F.struct(F.col(f"l_{x}").alias("l"), F.lit(x).alias("lang")) for x in langs]), False)
    q_lang = by_question.select("pred_id", (ordered_langs[0]["lang"] if langs else F.lit(None).cast("string")).alias("latin_lang"))
    with_lang = parsed.select("pred_id", "q_script", "script", F.size("words").alias("n_words")).join(q_lang, "pred_id", "left")
    with_lang = with_lang.withColumn("lang", F.when(F.col("q_script").isin("zh", "ru"), F.col("q_script")).otherwise(F.col("latin_lang"))).where("lang IS NOT NULL AND script <> ''")
    with_lang = cut(with_lang.drop("latin_lang"), "languages")
    forget(asked), forget(q_rates)
    latin = cut(told_words.join(with_lang.select("pred_id", "lang"), "pred_id"), "told")
    forget(told_words)
    told = likelihoods(latin, cut(word_rates(latin), "rates"), langs).join(latin.select("pred_id", "lang").distinct(), "pred_id")
    own = F.coalesce(*[F.when(F.col("lang") == x, F.col(f"l_{x}")) for x in langs], F.lit(0.0))
    best = F.array_max(F.array(*[F.col(f"l_{x}") for x in langs], F.lit(-1e9)))
    foreign = told.where((F.col("n") >= 2) & (best - own > 2.0)).select("pred_id").unionByName(with_lang.where("(script = 'latin' AND q_script <> 'latin' AND n_words >= 2) OR (script <> 'latin' AND script <> q_script)").select("pred_id"))
    foreign = cut(foreign.distinct().withColumn("foreign", F.lit(True)), "foreign")

    judged = parsed.select("pred_id", "kind").join(begun, "pred_id", "left").join(foreign, "pred_id", "left")
    stopped = F.expr("kind = 'cut' OR kind = 'open' OR begun")
    defect = (
        F.when(F.col("kind").isin("empty", "copies_question", "refusal"), F.col("kind"))
        .when(stopped, F.lit("truncated"))
        .when(F.col("foreign"), F.lit("other_language"))
    )
    return judged.select("pred_id", defect.alias("defect")).where("defect IS NOT NULL")
