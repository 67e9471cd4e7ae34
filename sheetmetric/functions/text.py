"""Text predicates as SQL expression texts (evaluated in the JVM, no joins, no UDFs).

Dictionary chains are long; as SQL text each of them is parsed once instead of being put
together from hundreds of Python column calls.  Functions named ``*_sql`` take and return text.
"""
from __future__ import annotations

import re

from sheetmetric.model import fixed


def raw(text: str) -> str:
    """SQL literal without escape processing."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


def string_array(words) -> str:
    return "array(" + ", ".join(raw(w) for w in words) + ")"


def map_sql(values: dict) -> str:
    def one(v):
        return raw(v) if isinstance(v, str) else (f"{v!r}D" if isinstance(v, float) else str(v))
    return "map(" + ", ".join(f"{one(k)}, {one(v)}" for k, v in values.items()) + ")"


def norm_sql(x: str) -> str:
    """Trimmed upper case; null becomes the empty string."""
    return f"upper(trim(coalesce({x}, '')))"


def nonblank_sql(x: str) -> str:
    return f"trim(coalesce({x}, '')) <> ''"


def alternation(keywords) -> str:
    return "|".join(re.escape(k) for k in keywords)


def contains_any_sql(x: str, keywords) -> str:
    return f"({x} RLIKE {raw(alternation(keywords))})"


def let_sql(value: str, var: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``.

    The value is computed once, and a long keyword chain stays out of the generated Java
    class, whose methods would otherwise outgrow the compiler's limits.
    """
    return f"transform(array({value}), {var} -> {body})[0]"


def first_group_sql(x: str, groups, default: str = "NULL") -> str:
    """Label of the first group (in declared order) one of whose keywords occurs in ``x``."""
    whens = " ".join(f"WHEN {contains_any_sql('g', [k.upper() for k in words])} THEN {raw(label)}" for label, words in groups)
    return let_sql(x, "g", f"CASE {whens} ELSE {default} END")


def has_cjk(word: str) -> bool:
    return any("一" <= ch <= "鿿" for ch in word)


def token_pattern(word: str) -> str:
    """Regex for one keyword: CJK as substring, Latin words bounded by non-alphanumerics."""
    word = word.strip().upper()
    if has_cjk(word):
        return re.escape(word)
    return f"(?<![A-Z0-9]){re.escape(word)}(?![A-Z0-9])"


def component_pattern(keywords) -> str:
    """Like ``token_pattern``, with the preceding characters that turn a CJK word into another."""
    parts = []
    for word in keywords:
        before = fixed.EXCLUDED_PRECEDING.get(word)
        parts.append(f"(?<![{before}]){re.escape(word)}" if before else token_pattern(word))
    return "|".join(parts)


def token_match_sql(x: str, words) -> str:
    words = [w for w in words if w.strip()]
    if not words:
        return "false"
    return f"(upper({x}) RLIKE {raw('|'.join(token_pattern(w) for w in words))})"


def tokens_sql(x: str) -> str:
    """Latin/digit runs of two or more, CJK runs of up to two as is, longer ones as 2-grams."""
    latin = f"regexp_extract_all({x}, r'[A-Za-z0-9_\\-]{{2,}}', 0)"
    runs = f"regexp_extract_all({x}, r'[一-鿿]+', 0)"
    grams = f"transform({runs}, t -> CASE WHEN length(t) <= 2 THEN array(t) ELSE transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)) END)"
    return f"concat({latin}, flatten({grams}))"


def expand_keyword(word: str) -> list[str]:
    """A query word with its dictionary synonyms, case-insensitively distinct, in order."""
    word = word.strip()
    found = [word]
    for key, terms in fixed.SYNONYMS:
        if key in word:
            found += terms
    seen: dict[str, str] = {}
    for term in found:
        seen.setdefault(term.upper(), term)
    return list(seen.values())
