"""Query understanding by SQL functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# Runs that are one token, phrases and characters that are written otherwise, names of times, and measures with their unit.
CHUNK = "[a-z0-9]+|[\\u4e00-\\u9fff]+"
ALIASES = {
    "蘋果": "苹果", "手機": "手机", "電腦": "电脑", "東京": "东京", "东jing": "东京", "dongjing": "东京", "beijing": "北京", "shanghai": "上海",
    "guangzhou": "广州", "shenzhen": "深圳", "hangzhou": "杭州", "xian": "西安",
}
CHARACTERS = {
    "蘋": "苹", "國": "国", "業": "业", "電": "电", "腦": "脑", "機": "机", "東": "东", "臺": "台", "灣": "湾", "書": "书", "網": "网", "軟": "软", "體": "体",
    "貓": "猫", "車": "车", "門": "门", "頭": "头", "風": "风", "藥": "药",
}
TIMES = {"明早": "明天早上", "今早": "今天早上", "昨晚": "昨天晚上", "今晚": "今天晚上", "明晚": "明天晚上", "後天": "后天"}
UNITS = (("公里|千米", "km"), ("米", "m"), ("公斤|千克", "kg"), ("克", "g"), ("毫升|ml", "ml"), ("升|l", "l"))
# What becomes a space, besides control characters: emoji and symbols, punctuation, quotes, slashes and brackets.
NOISE = "[\\x{2600}-\\x{27BF}\\x{1F300}-\\x{1FAFF}，。！？、；：,.!?:;~`·•…“”\"‘’'/\\\\|()\\[\\]]"
LONGEST_QUERY = 100
# Phrases that tell what a query is after, in order, the word that stands for it, words that say little, and short terms that stay however common.
INTENTS = {
    "tutorial": ("怎么", "如何", "教程", "攻略", "步骤"),
    "compare": ("对比", "区别", "还是", "哪个好", "选哪"),
    "recommend": ("推荐", "种草", "买什么", "哪款", "适合"),
    "review": ("测评", "评测", "体验", "开箱", "值不值"),
    "health": ("胃药", "止吐", "头疼", "感冒", "症状", "药"),
    "fashion": ("穿搭", "搭配", "显瘦", "口红", "香水", "包"),
}
HINTS = {"tutorial": "教程", "compare": "对比", "recommend": "推荐", "review": "测评", "health": "症状", "fashion": "搭配"}
STOPWORDS = ("怎么", "如何", "一下", "一个", "一些", "可以", "有没有", "请问", "帮我", "给我", "推荐一下")
NEVER_COMMON = ("jk", "jk裙", "jk制服")
#: Full-width forms of ASCII, which compatibility forms write plainly.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"


def tokens(text: Column) -> Column:
    """Runs of Latin letters and digits and runs of Chinese characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(CHUNK), F.lit(0))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column, whole: bool = False) -> Column:
    """Compatibility forms: full-width ASCII as plain ASCII by SQL functions; with whole, all of Unicode's, in Python."""
    if whole:
        return _compatible(text)
    return F.translate(text, FULL_WIDTH, "".join(map(chr, range(0x21, 0x7F))) + " ")


def normalized(text: Column, most: int = LONGEST_QUERY, whole: bool = False) -> Column:
    """A query as it is compared: plain forms, lower-cased, aliases, characters and times written one way, thousands commas gone, measures with
    short units, noise as spaces, spaces collapsed, at most most characters. Null is empty."""
    out = F.regexp_replace(compatible(F.coalesce(text, F.lit("")), whole), r"[\x00-\x1f\x7f]", " ")
    out = F.lower(F.trim(out))
    for phrase, other in ALIASES.items():
        out = F.replace(out, F.lit(phrase), F.lit(other))
    out = F.translate(out, "".join(CHARACTERS), "".join(CHARACTERS.values()))
    for phrase, other in TIMES.items():
        out = F.replace(out, F.lit(phrase), F.lit(other))
    out = measures(F.regexp_replace(out, r"(?<=\d),(?=\d)", ""))
    out = F.regexp_replace(out, NOISE, " ")
    return F.rtrim(F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most))


def intents(query: Column, patterns: dict[str, tuple[str, ...]] = INTENTS, most: int = 3) -> Column:
    """The names of the first most patterns of which a normalised query holds a phrase."""
    found = []
    for name, phrases in patterns.items():
        held = F.lit(False)
        for phrase in phrases:
            held = held | F.contains(query, F.lit(phrase))
        found.append(F.when(held, name))
    return F.slice(F.array_compact(F.array(*found)), 1, most)


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters; a text of at most two characters is one; none of an empty text."""
    n, letters = F.length(text), F.split(text, "")
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(letters, F.lit(1), rest), F.slice(letters, F.lit(2), rest), lambda a, b: F.concat(a, b))  # linear in the text's length
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 2, F.array(text)).otherwise(F.array_distinct(pairs))


def bounded_edits(a: Column, b: Column, most: int) -> Column:
    """Edits between two texts, most + 1 for any number above most."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def seed_terms(query: Column) -> Column:
    """The chunks of a normalised query, the first and last two characters of Chinese chunks of four or more, and the query without
    spaces; each once, in that order."""

    def parts(chunk: Column) -> Column:
        long = chunk.rlike("^[\\u4e00-\\u9fff]{4,}$")
        return F.when(long, F.array(chunk, F.substring(chunk, 1, 2), F.substring(chunk, -2, 2))).otherwise(F.array(chunk))

    found = F.flatten(F.transform(F.regexp_extract_all(query, F.lit(CHUNK), F.lit(0)), parts))
    return F.array_distinct(F.filter(F.concat(found, F.array(F.replace(query, F.lit(" "), F.lit("")))), lambda t: t != ""))


def bucket_key(term: Column) -> Column:
    """The two first characters of a term of Latin letters and digits, else the first."""
    return F.when(term.rlike("^[a-z0-9]+$"), F.substring(term, 1, 2)).otherwise(F.substring(term, 1, 1))


def match_score(query: Column, title: Column, content: Column) -> Column:
    """How well a normalised query matches a text: whole occurrences and shared pairs of characters; 0 for an empty query."""
    pairs = bigrams(query)

    def share(text: Column) -> Column:
        return F.size(F.array_intersect(pairs, bigrams(text))) / F.greatest(F.size(pairs), F.lit(1))

    # Weights and thresholds.
    whole = F.when(F.contains(title, query), 3.0).otherwise(0.0) + F.when(F.contains(content, query), 1.0).otherwise(0.0)
    return F.when(query == "", F.lit(0.0)).otherwise(whole + 2.0 * share(title) + 0.5 * share(F.substring(content, 1, 500)))


# How topics are written in a text.
TOPIC = r"#\[([^\]#]{1,40})\]#|#([^#\[\]]{1,40})\[话题\]#"


def topic_tags(text: Column, limit: int = 3) -> Column:
    """The distinct topics of a text, in order, at most limit."""
    groups = [F.regexp_extract_all(text, F.lit(TOPIC), F.lit(i)) for i in (1, 2)]
    named = F.zip_with(*groups, lambda a, b: F.trim(F.when(a != "", a).otherwise(b)))
    return F.slice(F.array_distinct(F.filter(named, lambda m: m != "")), 1, limit)


def built(title: Column, content: Column) -> Column:
    """What is encoded of a document: title and content without blanks around them, each named, and only those that are not blank."""
    title, content = (F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r")) for c in (title, content))
    named = lambda name, c: F.concat(F.lit(f"{name}："), c)
    both = F.concat(named("title", title), F.lit("\n"), named("content", content))
    return F.when((title != "") & (content != ""), both).when(title != "", named("title", title)).otherwise(named("content", content))


def shown_title(title: Column, content: Column) -> Column:
    """The title; without one, a placeholder with the topics of the content."""
    tags = topic_tags(F.coalesce(content, F.lit("")))
    named = F.concat(F.lit("(无标题) "), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t, F.lit("[话题]#"))), " "))
    clean = F.trim(F.coalesce(title, F.lit("")))
    return F.when(clean != "", clean).when(F.size(tags) > 0, named).otherwise(F.lit("(无标题)"))


def measures(text: Column) -> Column:
    """Numbers with a unit, written together with the short unit; in the order of UNITS."""
    for words, unit in UNITS:
        text = F.regexp_replace(text, rf"(\d+(?:\.\d+)?)\s*(?:{words})", f"$1{unit}")
    return text


def search_score(query: Column, title: Column, content: Column, terms: Column | None = None, wanted: Column | None = None) -> Column:
    """How well a document matches a search: whole occurrences, shared pairs of characters, shares of terms found, and intents of which a phrase is there.
    All arguments normalised; without terms, the query's seed terms; without wanted, its intents."""
    grams = bigrams(query)
    terms = seed_terms(query) if terms is None else terms
    wanted = intents(query) if wanted is None else wanted

    def share(text: Column) -> Column:
        return F.size(F.array_intersect(grams, bigrams(text))) / F.greatest(F.size(grams), F.lit(1))

    def held(text: Column) -> Column:
        return F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.greatest(F.size(terms), F.lit(1))

    matched: Column = F.lit(0)
    for name, phrases in INTENTS.items():
        there = F.lit(False)
        for phrase in phrases:
            there = there | F.contains(title, F.lit(phrase)) | F.contains(content, F.lit(phrase))
        matched = matched + F.when(F.array_contains(wanted, name) & there, 1).otherwise(0)
    # Weights and thresholds.
    whole = F.when(F.contains(title, query), 3.2).otherwise(0.0) + F.when(F.contains(content, query), 1.0).otherwise(0.0)
    found = whole + 1.4 * share(title) + 0.35 * share(F.substring(content, 1, 500)) + 1.7 * held(title) + 0.55 * held(content) + 0.30 * matched
    return F.when(query == "", F.lit(0.0)).otherwise(found)


def lexical_features(query: Column, title: Column, content: Column, terms: Column, wanted: Column) -> dict[str, Column]:
    """exact (the query stands in title or content), hits, cover and intent (both at most 1.5). All arguments normalised."""

    def hits(text: Column) -> Column:
        return F.size(F.filter(terms, lambda t: F.contains(text, t)))

    # Weights and thresholds.
    evidence: Column = F.lit(0.0)
    for name, phrases in INTENTS.items():
        found: Column = F.lit(0.0)
        for phrase in phrases:
            found = found + F.when(F.contains(title, F.lit(phrase)), 0.7).otherwise(0.0) + F.when(F.contains(content, F.lit(phrase)), 0.3).otherwise(0.0)
        evidence = evidence + F.when(F.array_contains(wanted, name), found).otherwise(0.0)
    bounded = lambda part, whole: F.least(F.lit(1.5), F.greatest(F.lit(0.0), part / F.greatest(F.size(whole), F.lit(1))))
    some = query != ""
    return {
        "exact": F.when(some & (F.contains(title, query) | F.contains(content, query)), 1).otherwise(0),
        "hits": F.when(some, hits(title) + hits(content)).otherwise(0).cast("double"),
        "cover": F.when(some, bounded(hits(title) + 0.45 * hits(content), terms)).otherwise(0.0),
        "intent": F.when(some, bounded(evidence, wanted)).otherwise(0.0),
    }
