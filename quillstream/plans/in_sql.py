"""The text rules of ``functions.text`` as DuckDB expressions, from the same fixed values."""

from __future__ import annotations

from ..functions import text

_SPACE = "'\\s+'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chosen(value: str, pairs: dict[str, str], other: str) -> str:
    return f"case {value} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in pairs.items()) + f" else {other} end"


def _collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, {_SPACE}, ' ', 'g'))"


def normalized(c: str) -> str:
    """O-STR-1."""
    quotes, plain = quoted("‘’“”"), quoted("''\"\"")
    straight = f"translate(lower(trim(coalesce({c}, ''))), {quotes}, {plain})"
    words = f"array_to_string(list_transform(string_split_regex({straight}, {_SPACE}), lambda w: {_chosen('w', text.CONTRACTIONS, 'w')}), ' ')"
    out = _collapsed(f"regexp_replace({words}, '[^a-z0-9]+', ' ', 'g')")
    return phrased(out)


def phrased(out: str) -> str:
    for pattern, instead in text.PHRASES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(instead)}, 'g')"
    return _collapsed(out)


def stem(w: str) -> str:
    """O-STR-2."""
    rules = []
    for suffix in text.SUFFIXES:
        base = f"left({w}, length({w}) - {len(suffix)})"
        base = f"(case when ends_with({base}, 'i') then left({base}, length({base}) - 1) || 'y' else {base} end)"
        doubled = f"length({base}) > 3 and right({base}, 1) = left(right({base}, 2), 1) and right({base}, 1) not in ('s', 'l', 'a', 'e', 'o')"
        rules.append(f"when ends_with({w}, '{suffix}') and length({w}) - {len(suffix)} >= 3 then case when {doubled} then left({base}, length({base}) - 1) else {base} end")
    return _chosen(w, text.IRREGULAR_STEMS, f"case when length({w}) <= 4 then {w} " + " ".join(rules) + f" else {w} end")


def tokens(normal: str) -> str:
    """O-STR-3, joined by blanks."""
    stops = ", ".join(quoted(w) for w in text.STOP_WORDS)
    return f"array_to_string(list_transform(list_filter(string_split({normal}, ' '), lambda w: length(w) > 1 and w not in ({stops})), lambda w: {stem('w')}), ' ')"
