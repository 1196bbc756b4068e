"""Text functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The concepts that queries and articles are tagged with, and the words that stand for them.
CONCEPTS = {
    "인간의 존엄": ["존엄", "존중", "인권", "인격", "가치"],
    "평등권": ["평등", "차별", "차별금지", "동등"],
    "자유권": ["자유", "자유로운"],
    "참정권": ["참정", "선거", "투표", "피선거권", "선거권"],
    "청구권": ["청구", "소송", "재판", "청원"],
    "사회권": ["사회권", "교육", "근로", "주거", "환경"],
    "신체의 자유": ["체포", "구속", "영장", "고문"],
    "언론의 자유": ["언론", "출판", "집회", "결사"],
    "재산권": ["재산", "소유", "재산권"],
    "통치구조": ["대통령", "국회", "법원", "헌법재판소", "정부", "행정부", "입법부", "사법부"],
    "기본권": ["기본권", "인권", "권리", "자유"],
}
# Particles that a query loses, and genres with their words, in order of precedence.
PARTICLES = "은|는|이|가|을|를|에|에서|대해|관해|에대해"
GENRES = {
    "technical": ["algorithm", "theorem", "proof", "정리", "증명", "알고리즘", "function", "class"],
    "academic": ["research", "study", "analysis", "연구", "분석", "hypothesis", "가설"],
    "fiction": ["character", "dialogue", "scene", "캐릭터", "대화", "장면"],
    "textbook": ["exercise", "example", "definition", "연습문제", "예제", "정의"],
}
# Whole lines that carry no content.
NOISE = [
    r"^\s*법제처\s*\d+\s*$",
    r"^\s*법제처\s*\d*\s*국가법령정보센터?\s*$",
    r"^\s*대한민국\s*헌법\s*$",
    r"^\s*대한민국헌법\s*$",
    r"^\s*대한민국헌법\s*\[\s*대한민국\s*\]\s*$",
    r"^.{2,20}\s*헌법\s*(?:개정\s*)?\[.{1,20}\]\s*$",
    r"^.{2,20}\s*헌법\s*개정\s*$",
    r"^\s*Page\s+\d+\s*$",
]
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def line_text(c: Column) -> Column:
    """A line with plain spaces: no-break spaces, tabs and runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), " ", " "), r"[ \t]+", " "))


def words(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Distinct tokens in lower case."""
    return F.array_distinct(words(F.lower(c)))


def term_keys(c: Column) -> Column:
    """Distinct tokens in lower case as 64-bit keys, which compare faster than strings."""
    return F.transform(terms(c), lambda w: F.xxhash64(w))


def token_count(c: Column) -> Column:
    return F.size(words(c))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\v\f"))


def truncate(c: Column, limit: int, suffix: str) -> Column:
    kept = strip(c)
    return F.when(F.length(kept) > limit, F.concat(F.substring(kept, 1, limit), F.lit(suffix))).otherwise(kept)


def fit(c: Column, limit: int, suffix: str = " ...[truncated]", room: int = 20) -> Column:
    """At most limit characters; what is longer loses room characters for the suffix."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - room), F.lit(suffix))).otherwise(c)


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def key_text(c: Column) -> Column:
    """A trimmed string; empty ones are null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def article_numbers(c: Column) -> Column:
    """Article numbers that a text names, ascending."""
    ko = F.regexp_extract_all(c, F.lit(r"제\s*(\d+)\s*조"), F.lit(1))
    en = F.regexp_extract_all(c, F.lit(r"(?i)Article\s*\(?\s*(\d+)\s*\)?"), F.lit(1))
    return F.array_sort(F.transform(F.array_distinct(F.concat(ko, en)), lambda x: x.cast("int")))


def concepts(c: Column, fold: bool = False) -> Column:
    """Concepts with any word in the text, in the order of CONCEPTS."""
    text = F.lower(c) if fold else c
    found = []
    for name, keys in CONCEPTS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | text.contains(k.lower() if fold else k)
        found.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def analysis(c: Column, lang: str = "ko") -> Column:
    """What a query asks for: article, chapter and paragraph numbers, concepts, strategy, canonical text."""
    ko = F.regexp_extract_all(c, F.lit(r"제\s*(\d+)\s*조"), F.lit(1))
    articles = F.array_distinct(F.concat(ko, F.regexp_extract_all(c, F.lit(r"(?i)Article\s+(\d+)"), F.lit(1)))) if lang == "en" else F.array_distinct(ko)
    articles = F.transform(F.array_sort(F.transform(articles, lambda x: x.cast("int"))), lambda x: x.cast("string"))
    chapters = F.array_distinct(F.regexp_extract_all(c, F.lit(r"제\s*(\d+)\s*장"), F.lit(1)))
    paragraphs = F.concat(F.regexp_extract_all(c, F.lit(r"제\s*(\d+)\s*항"), F.lit(1)), F.regexp_extract_all(c, F.lit(f"([{CIRCLED}])"), F.lit(1)))
    found = concepts(c)
    strategy = F.when(F.size(articles) == 1, "exact_article").when(F.size(articles) > 1, "multi_article").when(F.size(found) > 0, "concept").otherwise("hybrid")
    return F.struct(c.alias("original_query"), canonical(c, lang).alias("optimized_query"), articles.alias("article_filters"), chapters.alias("chapter_filters"), paragraphs.alias("paragraph_filters"), found.alias("concept_keywords"), strategy.alias("search_strategy"))


def canonical(c: Column, lang: str = "ko") -> Column:
    """Article references in one spelling; for Korean without particles that stand between spaces."""
    out = F.regexp_replace(c, r"제\s*(\d+)\s*조", "제$1조")
    if lang == "en":
        out = F.regexp_replace(out, r"(?i)Article\s+(\d+)", "제$1조")
    if lang == "ko":
        out = F.regexp_replace(out, rf"\s+({PARTICLES})\s+", " ")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), c)


def keywords(c: Column) -> Column:
    """Distinct tokens of two letters or more with Hangul in them."""
    return F.array_sort(F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= 2) & w.rlike("[가-힣]"))))


def header_number(line: Column, strict_circled: bool = False) -> Column:
    """The number of the article whose header a line is, else null. By default circled digits count as one literal run."""
    circled = f"[{CIRCLED[:10]}]" if strict_circled else CIRCLED[:10]
    ko = F.regexp_extract(line, rf"(?d)^\s*제\s*(\d+)\s*조(?:\s|{circled}|$|\(|\[|의|【|〔)", 1)
    reference = line.rlike(r"(?i)^\s*Article\s+\d+\s+(?:of|the|this|that|in|to|a|an|which|shall|provides|is|are|and|or|has|have|was|were)\b")
    alone = F.regexp_extract(line, r"(?id)^\s*Article\s*\(?\s*(\d+)\s*\)?\.?\s*$", 1)
    paren = F.regexp_extract(line, r"(?i)^\s*Article\s*\(\s*(\d+)\s*\)", 1)
    numbered = F.regexp_extract(line, r"^\s*\d+\s+제\s*(\d+)\s*조", 1)
    pick = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(pick(ko), F.when(~reference, F.coalesce(pick(alone), pick(paren))), pick(numbered))


def paragraph_key(line: Column) -> Column:
    """The first circled digit anywhere in a line, else a leading 1 to 20."""
    lead = F.regexp_extract(line, r"^\s*(\d{1,2})[.)\s]", 1)
    return F.coalesce(F.nullif(F.regexp_extract(line, f"([{CIRCLED}])", 1), F.lit("")), F.when(F.nullif(lead, F.lit("")).cast("int").between(1, 20), lead))


def is_noise(line: Column) -> Column:
    """Lines without content; article headers are never noise."""
    out = F.lit(False)
    for p in NOISE:
        out = out | line.rlike(p)
    return out & header_number(line).isNull()


def structure_level(line: Column) -> Column:
    """A part, book, chapter, section or subsection heading: its level, else null."""
    level = F.regexp_extract(line, r"^\s*제?\s*[0-9]+\s*(편|부|장|절|관)\s*.{0,40}$", 1)
    return F.when(header_number(line).isNull(), F.nullif(level, F.lit("")))


def display_path(article: Column, paragraph: Column, lang: str = "ko") -> Column:
    head = F.concat(F.lit("제"), article.cast("string"), F.lit("조")) if lang == "ko" else F.concat(F.lit("Article "), article.cast("string"))
    return F.when(F.coalesce(paragraph.cast("string"), F.lit("")) != "", F.concat(head, F.lit(" "), paragraph.cast("string"), F.lit("항"))).otherwise(head)


def article_id(country: Column, version: Column, article: Column, paragraph: Column, doc: Column, seq: Column) -> Column:
    v = F.coalesce(key_text(version), F.lit("latest"))
    head = F.concat_ws(":", country, v)
    a, p = key_text(article), key_text(paragraph)
    named = F.concat_ws(":", head, F.coalesce(a, F.lit("unknown")))
    return F.when(p.isNotNull(), F.concat_ws(":", named, p)).when(a.isNotNull(), named).when(doc.isNotNull() & seq.isNotNull(), F.concat_ws(":", head, doc.cast("string"), seq.cast("string"))).otherwise(F.concat_ws(":", head, F.lit("unknown")))


def country_of_file(name: Column, codes: list[str]) -> Column:
    """The registered country code at the start of a file name or between underscores."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    lead, inner = F.regexp_extract(base, "^([A-Z]{2})", 1), F.regexp_extract(base, r"_([A-Z]{2})(?:_|$)", 1)
    return F.when(lead.isin(codes), lead).when(inner.isin(codes), inner)


def version_of_file(name: Column) -> Column:
    """The year after ``_v`` or ``_``, else a date, with dashes."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    pick = lambda p: F.nullif(F.regexp_extract(base, p, 1), F.lit(""))
    return F.coalesce(pick(r"(?i)_v(\d{4})"), pick(r"_(\d{4})(?:_|$|-)"), F.regexp_replace(pick(r"_(\d{4}[-_]\d{2}[-_]\d{2})"), "_", "-"))


def genre(c: Column) -> Column:
    """The genre with most of its words present; none: general; ties by the order of GENRES."""
    low = F.lower(c)
    counts = {g: sum((low.contains(k.lower()).cast("int") for k in keys), F.lit(0)) for g, keys in GENRES.items()}
    most = F.greatest(*counts.values())
    out = F.lit("general")
    for g, n in reversed(counts.items()):
        out = F.when((n == most) & (most > 0), g).otherwise(out)
    return out


def text_type(ko: Column, en: Column) -> Column:
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(has(ko) & has(en), "bilingual").when(has(en), "english_only").otherwise("korean_only")


def sigmoid(s: Column, scale: float = 1.0) -> Column:
    """The logistic function; where its exponential overflows, one half."""
    x = -s.cast("double") * scale
    return F.when(x > 709.78, 0.5).otherwise(1 / (1 + F.exp(x)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def pixels(points: Column, dpi: int) -> Column:
    return (points.cast("double") * dpi / 72).cast("int")
