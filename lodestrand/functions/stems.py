"""Porter's stemmer as SQL expressions that Spark and DuckDB both take."""

from __future__ import annotations

_CONS, _VOWEL = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: What a stem must look like: one vowel-consonant change, exactly one, more than one; a vowel; consonant, vowel, consonant at the end.
M_OVER_0 = f"^({_CONS})?{_VOWEL}{_CONS}"
M_IS_1 = f"^({_CONS})?{_VOWEL}{_CONS}({_VOWEL})?$"
M_OVER_1 = f"^({_CONS})?{_VOWEL}{_CONS}{_VOWEL}{_CONS}"
HAS_VOWEL = f"^({_CONS})?[aeiouy]"
ENDS_CVC = f"^{_CONS}[aeiouy][^aeiouwxy]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

#: Suffixes and what takes their place, of the published algorithm's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

LIKE = {"spark": "rlike({}, '{}')", "duckdb": "regexp_matches({}, '{}')"}


def stem_steps(dialect: str, word: str = "w") -> list[str]:
    """Expressions over the column `word` that are to be applied one after another. Words of one or two letters stay."""
    like = lambda of, pattern: LIKE[dialect].format(of, pattern)
    cut = lambda n: f"left({word}, length({word}) - {n})"
    ends = lambda suffix: f"right({word}, {len(suffix)}) = '{suffix}'"

    def swap(rules: dict[str, str], need: str, also: list[str] = ()) -> str:
        """The longest suffix that fits decides, whether or not its stem meets the need."""
        cases = {s: f"when {ends(s)} then case when {like(cut(len(s)), need)} then concat({cut(len(s))}, '{r}') else {word} end" for s, r in rules.items()}
        return "case " + " ".join([*also, *(cases[s] for s in sorted(cases, key=lambda s: (-len(s), s)))]) + f" else {word} end"

    mended = lambda x: f"case when {like(x, '(at|bl|iz)$')} or {like(x, ENDS_CVC)} then concat({x}, 'e') when {like(x, DOUBLED)} then left({x}, length({x}) - 1) else {x} end"
    step_4 = swap({s: "" for s in STEP_4}, M_OVER_1, [f"when {ends('sion')} or {ends('tion')} then case when {like(cut(3), M_OVER_1)} then {cut(3)} else {word} end"])
    steps = [
        f"case when {ends('sses')} or {ends('ies')} then {cut(2)} when {ends('ss')} then {word} when {ends('s')} then {cut(1)} else {word} end",
        f"case when {ends('eed')} then case when {like(cut(3), M_OVER_0)} then {cut(1)} else {word} end when {ends('ed')} and {like(cut(2), HAS_VOWEL)} then {mended(cut(2))} when {ends('ing')} and {like(cut(3), HAS_VOWEL)} then {mended(cut(3))} else {word} end",
        f"case when {ends('y')} and {like(cut(1), HAS_VOWEL)} then concat({cut(1)}, 'i') else {word} end",
        swap(STEP_2, M_OVER_0),
        swap(STEP_3, M_OVER_0),
        step_4,
        f"case when {ends('e')} and ({like(cut(1), M_OVER_1)} or ({like(cut(1), M_IS_1)} and not {like(cut(1), ENDS_CVC)})) then {cut(1)} else {word} end",
        f"case when {ends('ll')} and {like(word, M_OVER_1)} then {cut(1)} else {word} end",
    ]
    return steps


def stem_ctes(source: str, columns: str, word: str = "w", name: str = "stemmed") -> str:
    """DuckDB common table expressions that end in `name`: the columns of source and their word's stem."""
    parts, last = [f"{name}_0 as (select {columns}, {word}, {word} as _s from {source})"], f"{name}_0"
    steps = stem_steps("duckdb", "_s")
    for k, step in enumerate(steps, 1):
        here = name if k == len(steps) else f"{name}_{k}"
        parts.append(f"{here} as (select {columns}, {word}, case when length({word}) > 2 then {step} else _s end as _s from {last})")
        last = here
    return ", ".join(parts)
