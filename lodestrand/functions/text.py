"""Text expressions: tokens, safety flags, redaction and rounding. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search ignores.
STOP_WORDS = "a an and are as at be by describe does for from how i in is it its of on or relationship relationships that the this to what when where which why with".split()
#: Phrases and patterns of the safety flags.
INJECTION_PHRASES = ["ignore previous instructions", "ignore all previous instructions", "system prompt", "developer message", "reveal your instructions", "do not obey"]
SECRET_PATTERN = r"(?i)(api[_-]?key|bearer\s+[a-z0-9._-]{12,}|password\s*=|sk_live_[a-z0-9]+)"
KEY_PATTERN = "BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY"
EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
#: What redaction replaces, in order.
REDACTIONS = [
    ("email", EMAIL_PATTERN),
    ("phone", r"\+?\d[\d .()-]{7,}\d"),
    ("user_id", r"(?i)\buser[_-]?id\s*[:=]\s*[a-z0-9_-]+"),
    ("payment", r"(?i)\b(?:card|cc|payment)[_-]?(?:number)?\s*[:=]\s*\d[\d -]{11,19}"),
    ("auth_secret", r"(?i)\b(?:bearer\s+[a-z0-9._-]+|api[_-]?key\s*[:=]\s*\S+|password\s*=\s*\S+)"),
]

#: The letters that a match of a class begins with; and what the text must hold for one.
OPENINGS = {"user_id": "u", "payment": "cp", "auth_secret": "bap"}
NEEDLES = {"email": "@"}

#: Legal forms that a name is compared without.
LEGAL_FORMS = ["limited liability company", "llc", "l l c", "incorporated", "inc", "corp", "corporation", "ltd", "limited", "gmbh", "plc", "lp", "llp"]


def bounded(pattern: str) -> str:
    """The pattern with word bounds of ASCII letters, digits and underscores, as they are meant; Java 17 takes other letters for word characters at \\b too."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def opened(letters: str, rest: str) -> str:
    """The same matches as of \\b before a pattern that begins with one of the letters: they are looked at first, so that most places cost one comparison."""
    return f"(?=[{letters}])(?<![A-Za-z0-9_]){rest}"


def of_words(pattern: str) -> str:
    """The same matches as of \\b(word|word...)\\b, with bounds of ASCII."""
    words = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    return opened("".join(sorted({w[0] for w in words.split("|")})), f"(?:{words})(?![A-Za-z0-9_])")


def scan_of(name: str, pattern: str) -> str:
    """A redaction pattern in a form that finds the same matches in time linear in the text.

    An address begins where a run of its characters does, or where the last match
    ended: a run without an @ is not tried again from each of its characters.
    """
    if name == "email":
        run, rest = EMAIL_PATTERN.removeprefix("(?i)").split("+@", 1)
        return rf"(?i)(?:\G|(?<!{run})){run}++@{rest}"
    if name in OPENINGS:
        return "(?i)" + opened(OPENINGS[name], pattern.removeprefix(r"(?i)\b"))
    return pattern


def half_up(value: Column, digits: int) -> Column:
    """Rounding with halves upward, whatever the sign."""
    return F.floor(value * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def terms(text: Column) -> Column:
    """Distinct search terms in order; a text of stop words alone keeps them."""
    every = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    telling = F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return (F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)


def normal_name(name: Column) -> Column:
    """A name for comparison: lower case, no apostrophes, full stops, commas or legal forms, single spaces."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[\u2019\u2018']", ""), "[.,]", " ")
    bare = F.regexp_replace(plain, bounded(rf"\b({'|'.join(LEGAL_FORMS)})\b"), " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def safety_flags(text: Column, most_chars: int = 1800) -> Column:
    low = F.lower(text)
    injected = F.lit(False)
    for phrase in INJECTION_PHRASES:
        injected = injected | F.contains(low, F.lit(phrase))
    return F.array_compact(
        F.array(
            F.when(injected, F.lit("possible_prompt_injection")),
            F.when(F.rlike(text, F.lit(SECRET_PATTERN)) | F.rlike(text, F.lit(KEY_PATTERN)), F.lit("secret_like_text")),
            F.when(F.contains(text, F.lit("@")) & F.rlike(text, F.lit(scan_of("email", EMAIL_PATTERN))), F.lit("sensitive_personal_data")),
            F.when(F.length(text) > most_chars, F.lit("oversized_chunk")),
        )
    )


def redaction(text: Column, classes: list[str] | None = None) -> Column:
    """A struct of the text with each match named, `out`, and how many there were, `n`.

    A lambda binds what each class reads several times; as columns on columns the
    steps would multiply. Only a text with a match is written anew.
    """
    bind = lambda value, to: F.get(F.transform(F.array(value), to), 0)

    def step(name: str, pattern: str):
        def counted(s: Column) -> Column:
            n = F.regexp_count(s["out"], F.lit(pattern))
            if name in NEEDLES:
                n = F.when(F.contains(s["out"], F.lit(NEEDLES[name])), n).otherwise(0)
            changed = F.regexp_replace(s["out"], pattern, f"[REDACTED:{name}]")
            return bind(n, lambda k: F.struct(F.when(k > 0, changed).otherwise(s["out"]).alias("out"), (s["n"] + k).alias("n")))

        return counted

    state = F.struct(text.alias("out"), F.lit(0).cast("long").alias("n"))
    for name, pattern in REDACTIONS:
        if classes is None or name in classes:
            state = bind(state, step(name, scan_of(name, pattern)))
    return state


def redacted(text: Column, classes: list[str] | None = None) -> tuple[Column, Column]:
    """The text with each match named, and how many there were. Who wants both takes redaction() and looks into it."""
    found = redaction(text, classes)
    return found["out"], found["n"]
