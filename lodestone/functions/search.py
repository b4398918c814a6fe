"""Full-text search with columns: lexemes with positions, queries, ranking.

A text-search vector is a sorted array<struct<lexeme, positions>>; a query is a string of
lexemes with &, |, ! and <->.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.arrays import _boolean

#: Words that a query or a vector leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def _lexemes(text: Column, stop: bool, only: tuple[str, ...] | None = None) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position")))
    if only is not None:
        placed = F.filter(placed, lambda s: s["lexeme"].isin(*only))
    if not stop:
        return placed
    known = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(placed, lambda s: ~F.array_contains(known, s["lexeme"]))


def to_tsvector(text: Column, stop: bool = True, only: tuple[str, ...] | None = None) -> Column:
    """Lexemes are the words in lower case; stop words keep their place but are left out.

    The places are sorted by lexeme once and cut where the lexeme changes.  ``only``: the lexemes
    that are asked for, so that the others are not sorted.
    """

    def cut(placed: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(placed) - 1)
        new = lambda i: (i == 0) | (F.get(placed, i)["lexeme"] != F.get(placed, i - 1)["lexeme"])
        starts = F.when(F.size(placed) > 0, F.filter(at, new)).otherwise(F.array().cast("array<int>"))
        return let(starts, lambda first: F.transform(first, lambda x, k: F.struct(
            F.get(placed, x)["lexeme"].alias("lexeme"),
            F.transform(F.slice(placed, x + 1, F.coalesce(F.get(first, k + 1), F.size(placed)) - x), lambda s: s["position"]).alias("positions"))))

    return let(F.array_sort(_lexemes(text, stop, only)), cut)


def strip(vector: Column) -> Column:
    return F.transform(vector, lambda s: s["lexeme"])


def positions(vector: Column, lexeme: str) -> Column:
    hits = F.filter(vector, lambda s: s["lexeme"] == lexeme)
    return F.coalesce(F.try_element_at(hits, F.lit(1))["positions"], F.array().cast("array<int>"))


def matches(vector: Column, query: str) -> Column:
    """vector @@ query; ``a <-> b`` (or <n>) asks for neighbours, ``a:*`` for a prefix."""
    tokens = re.findall(r"[^\s&|!()<>]+(?:\s*<(?:-|\d+)>\s*[^\s&|!()<>]+)*|[&|!()]", query.lower())

    def leaf(token: str) -> Column:
        parts = re.split(r"\s*<(-|\d+)>\s*", token)
        if len(parts) == 1:
            if token.endswith(":*"):
                return F.exists(vector, lambda s: F.startswith(s["lexeme"], F.lit(token[:-2])))
            return F.exists(vector, lambda s: s["lexeme"] == token)
        at = positions(vector, parts[0])
        for gap, word in zip(parts[1::2], parts[2::2], strict=True):
            n = 1 if gap == "-" else int(gap)
            at = F.array_intersect(F.transform(at, lambda p: p + n), positions(vector, word))
        return F.size(at) > 0

    return _boolean([t.strip() for t in tokens], leaf)


def plain_query(text: str) -> str:
    """plainto_tsquery: all words."""
    return " & ".join(w for w in re.findall(r"\w+", text.lower()) if w not in STOP_WORDS)


def phrase_query(text: str) -> str:
    """phraseto_tsquery: the words in a row, stop words counting as gaps."""
    out, gap = [], 0
    for w in re.findall(r"\w+", text.lower()):
        gap += 1
        if w in STOP_WORDS:
            continue
        if out:
            out.append("<->" if gap == 1 else f"<{gap}>")
        out.append(w)
        gap = 0
    return " ".join(out)


def web_query(text: str) -> str:
    """websearch_to_tsquery: "phrases", or, and -words."""
    out = []
    for no, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or":
            out.append("|")
            continue
        q = phrase_query(phrase) if phrase else plain_query(word)
        if q:
            if out and out[-1] != "|":
                out.append("&")
            out.append(("!" if no else "") + (f"({q})" if no and " " in q else q))
    return " ".join(out)


def rank(vector: Column, *lexemes: str, weight: float = 0.1) -> Column:
    """Frequency ranking: each lexeme adds the sum of weight / place squared over its occurrences, scaled."""
    terms = []
    for x in lexemes:
        at = positions(vector, x)
        total = F.aggregate(F.transform(at, lambda p, i: F.lit(weight) / ((i + 1.0) * (i + 1.0))), F.lit(0.0), lambda s, v: s + v)
        terms.append(total / F.lit(1.64493406685))
    return sum(terms[1:], terms[0]) / len(terms)


def headline(text: Column, *words: str, start: str = "<b>", stop: str = "</b>") -> Column:
    """ts_headline over the whole text: hits are marked."""
    hits = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({hits})(?![\p{{L}}\p{{N}}])", f"{start}$1{stop}")


#: Kinds of tokens and what they look like, the first that fits.
TOKENS = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "url": r"https?://\S+", "float": r"[-+]?\d+\.\d+", "uint": r"\d+", "asciiword": r"[A-Za-z]+(?!\p{L})", "word": r"\p{L}+"}


def parse_tokens(text: Column) -> Column:
    """ts_parse: array of (kind, token); blanks and marks are left out."""
    every = F.regexp_extract_all(text, F.lit("(" + "|".join(f"(?:{p})" for p in TOKENS.values()) + ")"), F.lit(1))

    def kind(token: Column) -> Column:
        out = F.lit("word")
        for name, pattern in reversed(TOKENS.items()):
            out = F.when(token.rlike(f"^(?:{pattern})$"), name).otherwise(out)
        return out

    return F.transform(every, lambda t: F.struct(kind(t).alias("kind"), t.alias("token")))


def lexize(token: Column, synonyms: dict[str, str] | None = None, stop: bool = True) -> Column:
    """ts_lexize with a synonym list before a simple dictionary: an empty array for a stop word, NULL only for NULL."""
    low = F.lower(token)
    out = F.array(low)
    if stop:
        out = F.when(low.isin(*STOP_WORDS), F.array().cast("array<string>")).otherwise(out)
    for word, same in (synonyms or {}).items():
        out = F.when(low == word, F.array(F.lit(same))).otherwise(out)
    return F.when(token.isNotNull(), out)


def json_lexemes(j: Column) -> Column:
    """json_to_tsvector over the string values of a flat object: the sorted distinct lexemes."""
    texts = F.map_values(F.from_json(j, "map<string,string>"))
    return F.array_sort(F.array_distinct(strip(to_tsvector(F.array_join(texts, " ")))))


def set_weight(vector: Column, weight: str) -> Column:
    """setweight: each lexeme with its positions and this weight (A to D)."""
    return F.transform(vector, lambda s: F.struct(s["lexeme"].alias("lexeme"), s["positions"].alias("positions"), F.lit(weight).alias("weight")))


def filter_weights(vector: Column, *weights: str) -> Column:
    """ts_filter."""
    return F.filter(vector, lambda s: s["weight"].isin(*weights))


def delete(vector: Column, *lexemes: str) -> Column:
    """ts_delete."""
    return F.filter(vector, lambda s: ~s["lexeme"].isin(*lexemes))


def matches_words(text: Column, query: str, stop: bool = True) -> Column:
    """to_tsvector(text) @@ query where no phrase is asked for: over the distinct words, without places or order.

    Stop words are not in a vector, so a query for one finds nothing.
    """
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))

    def leaf(token: str) -> Column:
        if token.endswith(":*"):
            found = F.exists(words, lambda w: F.startswith(w, F.lit(token[:-2])) & ~(w.isin(*STOP_WORDS) if stop else F.lit(False)))
            return found
        return F.lit(False) if stop and token in STOP_WORDS else F.array_contains(words, token)

    return _boolean([t.strip() for t in re.findall(r"[^\s&|!()<>]+|[&|!()]", query.lower())], leaf)


def has_phrase(text: Column, phrase: str, stop: bool = True) -> Column:
    """to_tsvector(text) @@ words joined by <-> (or <n>), in one pass over the text and without a vector.

    Stop words are not in a vector, so a phrase with one finds nothing, unless ``stop`` is false.
    """
    first, *rest = re.split(r"\s*<(-|\d+)>\s*", phrase.strip().lower())
    gaps, others = rest[::2], rest[1::2]
    if not all(re.fullmatch(r"[^\W_]+", w) for w in (first, *others)) or (stop and any(w in STOP_WORDS for w in (first, *others))):
        return F.when(text.isNotNull(), F.lit(False))
    char, mark = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    if "0" in gaps:
        raise ValueError("the words of a phrase are one place apart at least")
    steps = [f"{mark}+(?:{char}+{mark}+){{{0 if g == '-' else int(g) - 1}}}{w}" for g, w in zip(gaps, others, strict=True)]
    return F.lower(text).rlike(f"(?<!{char}){first}{"".join(steps)}(?!{char})")
