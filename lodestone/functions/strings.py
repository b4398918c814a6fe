"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX classes and word marks, and what Java's regular expressions call them.
POSIX = {
    "[:alpha:]": r"\p{Alpha}", "[:digit:]": r"\d", "[:alnum:]": r"\p{Alnum}", "[:upper:]": r"\p{Upper}", "[:lower:]": r"\p{Lower}",
    "[:space:]": r"\s", "[:punct:]": r"\p{Punct}", "[:xdigit:]": r"\p{XDigit}", "[:cntrl:]": r"\p{Cntrl}", "[:print:]": r"\p{Print}",
    "[:graph:]": r"\p{Graph}", "[:blank:]": r"\p{Blank}", r"\m": r"\b(?=\w)", r"\M": r"\b(?<=\w)", r"\y": r"\b", r"\Y": r"\B",
}


def posix(pattern: str, flags: str = "") -> str:
    """An advanced regular expression as Java writes it; flags i, x, n, s."""
    for a, b in POSIX.items():
        pattern = pattern.replace(a, b)
    own = "".join({"i": "i", "x": "x", "n": "m"}.get(f, "") for f in flags)
    return f"(?s{own})" + pattern if "n" not in flags else f"(?{own})" + pattern


def similar_to(text: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO: %, _ and the alternation, repetition and bracket marks of SQL; the whole text must match."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append("\\" + pattern[k] if not pattern[k].isalnum() else pattern[k])
        elif inside:
            out.append(c)
            inside = c != "]"
        elif c == "[":
            inside = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
        k += 1
    return text.rlike(f"(?s)^(?:{''.join(out)})$")


def concat(*parts: Column) -> Column:
    """concat(): NULLs are skipped, booleans read t and f."""
    return F.concat_ws("", *parts)


def bool_text(c: Column) -> Column:
    return F.when(c, "t").otherwise(F.when(~c, "f"))


def left(text: Column, n: int) -> Column:
    """left(): a negative n drops from the end."""
    return F.substring(text, 1, n) if n >= 0 else F.when(text.isNotNull(), F.coalesce(F.substring(text, F.lit(1), F.greatest(F.length(text) + n, F.lit(0))), F.lit("")))


def right(text: Column, n: int) -> Column:
    """right(): a negative n drops from the start."""
    keep = F.lit(n) if n >= 0 else F.greatest(F.length(text) + n, F.lit(0))
    keep = F.least(keep, F.length(text))
    return F.when(text.isNotNull(), F.substring(text, F.length(text) - keep + 1, keep))


def initcap(text: Column) -> Column:
    """First letter of each run of letters and digits upper, the rest lower."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def regexp_match(text: Column, pattern: str, flags: str = "") -> Column:
    """The groups of the first match (the whole match without groups), NULL without one."""
    import re

    java = posix(pattern, flags)
    n = re.compile(re.sub(r"\\p\{\w+\}", "x", java.replace("(?s)", ""))).groups
    found = F.array(*[F.regexp_extract(text, java, k) for k in (range(1, n + 1) if n else [0])])
    return F.when(text.rlike(java), found)


def regexp_replace(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Only the first match without flag g."""
    java = posix(pattern, flags.replace("g", ""))
    to = replacement.replace("$", r"\$").replace("\\&", "$0")
    for k in range(1, 10):
        to = to.replace(f"\\{k}", f"${k}")
    if "g" in flags:
        return F.regexp_replace(text, java, to)
    return F.when(text.rlike(java), F.regexp_replace(text, f"(?s)\\A((?:(?!{java}).)*){java}", "$1" + "".join(f"${int(p[0]) + 1}{p[1:]}" if i and p[:1].isdigit() else p for i, p in enumerate(to.split("$"))))).otherwise(text)


def quote_ident(text: Column) -> Column:
    plain = text.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(text: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.contains(text, F.lit("\\")), F.concat(F.lit(" E"), quoted)).otherwise(quoted)


def quote_nullable(text: Column) -> Column:
    return F.coalesce(quote_literal(text), F.lit("NULL"))


def format_text(template: str, *args: Column) -> Column:
    """format(): %s, %I, %L and %%; positions as %2$s."""
    import re

    out, at, turn = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        out.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            out.append(F.lit("%"))
            continue
        turn = int(m[1]) if m[1] else turn + 1
        x = args[turn - 1].cast("string")
        out.append({"s": lambda x: F.coalesce(x, F.lit("")), "I": quote_ident, "L": quote_nullable}[m[2]](x))
    out.append(F.lit(template[at:]))
    return F.concat(*out)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def encode(data: Column, kind: str) -> Column:
    """encode(bytea, hex | base64)."""
    return F.lower(F.hex(data)) if kind == "hex" else F.base64(data)


def decode(text: Column, kind: str) -> Column:
    return F.unhex(text) if kind == "hex" else F.unbase64(text)


def get_bit(data: Column, n: int) -> Column:
    """Bit n of a byte string, the lowest bit of each byte first."""
    byte = F.conv(F.hex(F.substring(data, n // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, n % 8).bitwiseAND(F.lit(1))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """The edit distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def difference(a: Column, b: Column) -> Column:
    """Equal places of the two soundex codes, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    return reduce(lambda s, k: s + (F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int"), range(1, 5), F.lit(0))


def trigrams(text: Column) -> Column:
    """show_trgm(): the distinct trigrams of each word, in lower case, with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, of))))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the two trigram sets."""
    x, y = trigrams(a), trigrams(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


#: Accented letters and what they become.
ACCENTS = {"àáâãäåā": "a", "çćč": "c", "èéêëēę": "e", "ìíîïī": "i", "ñń": "n", "òóôõöøō": "o", "ùúûüū": "u", "ýÿ": "y", "ß": "S", "šś": "s", "žźż": "z"}


def unaccent(text: Column) -> Column:
    """Letters without their marks; ligatures and sharp s as two letters."""
    pairs = [(c, b) for a, b in ACCENTS.items() for c in a if c != "ß"]
    pairs += [(c.upper(), b.upper()) for c, b in pairs if c.upper() != c and len(c.upper()) == 1]
    out = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parse_ident(text: Column) -> Column:
    """Parts of a qualified name; unquoted ones in lower case."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"]|"")+"|[^".]+)'), F.lit(1))
    return F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(F.trim(p))))


def word_similarity(a: Column, b: Column) -> Column:
    """How much of ``a`` one stretch of words of ``b`` holds: the best Jaccard-like score of a's trigrams with trigrams of b in a row."""
    x = trigrams(a)
    words = F.filter(F.split(F.lower(b), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    placed = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))

    def best(row: Column) -> Column:
        y, x = row["y"], row["x"]
        known = F.filter(F.sequence(F.lit(1), F.size(y)), lambda i: F.array_contains(x, F.get(y, i - 1)))

        def score(i: Column, j: Column) -> Column:
            stretch = F.array_distinct(F.slice(y, i, j - i + 1))
            both = F.size(F.array_intersect(x, stretch))
            return both / (F.size(x) + F.size(stretch) - both)

        # a best stretch begins and ends with a trigram that both have
        every = F.flatten(F.transform(known, lambda i: F.transform(F.filter(known, lambda j: j >= i), lambda j: score(i, j))))
        return F.coalesce(F.array_max(every), F.lit(0.0))

    return F.transform(F.array(F.struct(placed.alias("y"), x.alias("x"))), best)[0]


def hmac(text: Column, key: bytes, bits: int = 256) -> Column:
    """hmac(data, key, 'sha<bits>') in hex: the digest over two paddings of the key."""
    import hashlib

    block = 64 if bits <= 256 else 128
    key = (hashlib.new(f"sha{bits}", key).digest() if len(key) > block else key).ljust(block, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(c ^ pad for c in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), bits))), bits)


def _uuid_of(digest: Column, version: int) -> Column:
    """The first 16 bytes of a hex digest as a UUID of this version."""
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit(str(version)), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def uuid_v3(namespace: str, name: Column) -> Column:
    """uuid_generate_v3: the MD5 of namespace and name."""
    return _uuid_of(F.md5(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))), 3)


def uuid_v5(namespace: str, name: Column) -> Column:
    """uuid_generate_v5: the SHA-1 of namespace and name."""
    return _uuid_of(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))), 5)


def get_byte(data: Column, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, n + 1, 1)), 16, 10).cast("int")


def set_byte(data: Column, n: int, value: int) -> Column:
    return F.overlay(data, F.unhex(F.lit(f"{value:02x}")), F.lit(n + 1), F.lit(1))
