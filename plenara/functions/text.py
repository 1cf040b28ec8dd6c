"""Column functions over text: normalisation, tokens, sentences, spans, questions, dates and direct identifiers.

Everything is built from JVM expressions but Unicode normalisation, case folding and the check of
IP addresses, which Spark has no function for and which run as Arrow UDFs.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that may begin a yes/no question.
AUXILIARIES = ("Am", "Are", "Can", "Could", "Did", "Do", "Does", "Had", "Has", "Have", "Is", "May", "Might", "Must", "Shall", "Should", "Was", "Were", "Will", "Would")
#: Fixed value: words and the signs that carry meaning in a rule.
CONTRACT_TOKEN = r"(?U)(?:!=|<=|>=|==)|[!~](?=\s*[^\W_])|-(?=\s*\d)|[^\W_]+|[¬≠≤≥=<>±+−%$€£¥∉∈∧∨]"
_SEPARATOR = "\x01"
#: The blanks of Unicode (category Zs).
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.StringType())
def nfkc_plain_space(text: pd.Series) -> pd.Series:
    """NFKC, with every Unicode white space but the ASCII ones as a blank."""
    plain = lambda t: "".join(" " if c.isspace() and not c.isascii() or "\x1c" <= c <= "\x1f" else c for c in unicodedata.normalize("NFKC", t))
    return text.map(lambda t: None if t is None else plain(t))


def _where_needed(step, text: Column, plain: Column | None = None) -> Column:
    """A Unicode step of texts that hold other signs than ASCII; of the others it is `plain` (the text as it is if not given), and they never leave the JVM."""
    return F.coalesce(step(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text if plain is None else plain)


def collapsed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def contract_text(text: Column) -> Column:
    """The form in which submitted and published texts are compared: NFKC, case folded, white space collapsed."""
    return collapsed(_where_needed(nfkc_casefold, text, F.lower(text)))


def anchor_identity(text: Column) -> Column:
    return contract_text(text)


def question_fingerprint(text: Column) -> Column:
    return _where_needed(nfc, text)


def word_tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def normalized_text(text: Column) -> Column:
    return F.array_join(word_tokens(text), " ")


def contract_tokens(text: Column) -> Column:
    """Words and meaningful signs of a text after NFKC and case folding."""
    return F.regexp_extract_all(_where_needed(nfkc_casefold, text, F.lower(text)), F.lit(CONTRACT_TOKEN), F.lit(0))


_TOKEN = re.compile(CONTRACT_TOKEN.removeprefix("(?U)"))


def contract_tokens_of(text: str) -> list[str]:
    """What contract_tokens gives, of a Python string."""
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def sentences(text: Column) -> Column:
    """Sentences, cut at white space after a full stop, exclamation or question mark, without blanks of any width at the ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s, F.lit(_BLANKS))), lambda s: s != "")


def ngram_features(tokens: Column) -> Column:
    """Tokens of three letters or more, and pairs of neighbours among them as a::b."""
    long = F.filter(tokens, lambda t: F.length(t) >= 3)
    pairs = F.zip_with(F.slice(long, 1, F.greatest(F.size(long) - 1, F.lit(0))), F.slice(long, 2, F.greatest(F.size(long) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("::"), b))
    return F.concat(long, F.when(F.size(long) > 1, pairs).otherwise(F.array().cast("array<string>")))


def contains_tokens(document: Column, quote: Column) -> Column:
    """Whether the quote's tokens stand in the document's, without a gap; no quote stands nowhere."""
    joined = lambda t: F.concat(F.lit(_SEPARATOR), F.array_join(t, _SEPARATOR), F.lit(_SEPARATOR))
    return (F.size(quote) > 0) & F.contains(joined(document), joined(quote))


def is_yes_no_question(text: Column) -> Column:
    """One auxiliary first, single blanks, and one question mark, at the end."""
    bare = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.coalesce((bare == text) & text.rlike(rf"^(?:{'|'.join(AUXILIARIES)}) [^?]+\?\z"), F.lit(False))


_QUESTION = re.compile(rf"(?:{'|'.join(AUXILIARIES)}) [^?]+\?")


def asks_yes_or_no(text: str) -> bool:
    """What is_yes_no_question gives, of a Python string."""
    return " ".join(text.split()) == text and _QUESTION.fullmatch(text) is not None


def scenario_id(template: Column, seed: Column) -> Column:
    """template-, and the first 12 hex digits of SHA-256 of template:seed."""
    return F.concat(template, F.lit("-"), F.substring(F.sha2(F.concat(template, F.lit(":"), seed.cast("string")), 256), 1, 12))


def is_canonical_date(text: Column) -> Column:
    """Whether a text is a date as yyyy-MM-dd that exists."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.date_format(day, "yyyy-MM-dd") == text), F.lit(False))


def density_prefix_size(count: Column, density: float) -> Column:
    """How many of `count` items a density leaves: at least one unless it is not positive, at most all."""
    if density <= 0:
        return F.lit(0)
    return F.least(count, F.greatest(F.lit(1), F.ceil(count * F.lit(float(density))).cast("int")))


def density_prefix(items: Column, density: float) -> Column:
    return F.slice(items, 1, density_prefix_size(F.size(items), density)) if density > 0 else F.slice(items, 1, 0)


#: Direct identifiers in the order in which they are looked for. Boundaries are ASCII word signs, so that an
#: identifier next to other scripts is found; look-behinds cover a pattern's own signs, so that long runs are read once.
IDENTIFIERS = (
    ("email", r"(?i)(?<![\w.%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w-]|\.[\w-])"),
    ("EVM address", r"(?i)(?<![0-9a-f])0x[0-9a-f]{40}(?![0-9a-f])"),
    ("ENS name", r"(?iU)(?<![\w@.-])[\w-]+(?:\.[\w-]+)*\.eth(?![A-Za-z0-9_])"),
    ("URL", r"(?i)(?<![\w.@/-])(?:https?://|www\.)[^\s<>\"']+"),
    ("social handle", r"(?<![\w@])@[A-Za-z_][A-Za-z0-9_.]*[A-Za-z0-9_]"),
    ("phone number", r"(?<!\w)(?:\+?[1-9]\d{7,14}|(?:\+?1[-. ]?)?\(?[2-9]\d{2}\)?[-. ]\d{3}[-. ]\d{4})(?!\w)"),
    ("honorific-name", r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\.?\s+[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+)?(?!\w)"),
)
#: What may be an identifier and is looked at again.
_INTERNATIONAL = r"(?<![\w+])\+[1-9]\d{0,3}(?>[- ]?\(?\d{1,4}\)?){2,6}(?!\w)"
_IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"
_IPV6 = r"(?i)(?<![\w:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![\w:])"


@F.pandas_udf(T.BooleanType())
def any_ip_address(candidates: pd.Series) -> pd.Series:
    def valid(c: str) -> bool:
        try:
            ipaddress.ip_address(c)
        except ValueError:
            return False
        return True

    return candidates.map(lambda cs: cs is not None and any(map(valid, cs)))


def direct_identifier(text: Column, normalize: bool = True) -> Column:
    """The first category of direct identifier in a text, or null. `normalize` False skips the Unicode step, for text known to be plain."""
    t = _where_needed(nfkc_plain_space, F.translate(text, "\x1c\x1d\x1e\x1f", "    ")) if normalize else text
    out = None
    for label, pattern in IDENTIFIERS:
        out = F.when(t.rlike(pattern), F.lit(label)) if out is None else out.when(t.rlike(pattern), F.lit(label))
    numbers = F.regexp_extract_all(t, F.lit(_INTERNATIONAL), F.lit(0))
    out = out.when(F.exists(numbers, lambda n: F.length(F.regexp_replace(n, r"\D", "")) >= 8), F.lit("phone number"))
    addresses = F.concat(F.regexp_extract_all(t, F.lit(_IPV4), F.lit(0)), F.regexp_extract_all(t, F.lit(_IPV6), F.lit(0)))
    return out.when(F.coalesce(any_ip_address(F.when(F.size(addresses) > 0, addresses)), F.lit(False)), F.lit("IP address"))


def hash60(*parts: Column) -> Column:
    """The first 15 hex digits of SHA-256 of the parts joined by blanks, as a long: a draw that any engine can repeat."""
    return F.conv(F.substring(F.sha2(F.concat_ws(" ", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")
