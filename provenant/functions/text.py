"""Column functions on text: cleaning, labels, names, references and file mentions. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists of the default sentiment lexicon.
POSITIVE = ("good great excellent amazing awesome nice helpful thanks thank love loved like liked success successful fixed fix works working resolved resolve clear clean improved improve correct stable fast").split()
NEGATIVE = ("bad terrible awful hate broken break breaking bug bugs error errors fail failed failing failure regression worse worst problem problems issue issues confusing unclear angry annoying frustrating slow blocked blocker wrong crash crashes crashed").split()
INTENSIFIERS = "very really extremely highly super too".split()
NEGATORS = "not no never none without hardly barely".split()
#: Texts that stand for a missing value.
NOT_REAL = ("nan", "none", "null", "nat", "<na>")
#: File suffixes that a bare file name may have.
SUFFIXES = "py js jsx ts tsx java go c cc cpp h hpp rb php rs swift kt scala r lua sh yml yaml json toml ini cfg conf xml html css scss md txt sql".split()
#: Characters of names of files and repositories.
NAME = "[A-Za-z0-9_.-]"
#: Patterns whose matches are part of the results: tokens of the lexicon, URLs, paths, references to issues, clauses that
#: close issues, bare file names, and addresses that hide a login. They are linear in the text and need no stack: what repeats is a single class or
#: possessive, and a search starts at the beginning of a run of name characters only, as a later start in it could match no more than that one.
TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
URL = r"(?i)\b(?:https?://|www\.)[^\s<>()\[\]{}\"']+"
#: Names joined by single slashes. A path is what of them ends in a suffix, up to the last one that does.
JOINED = rf"(?<!{NAME}){NAME}++(?:/{NAME}++)++"
PATH = r"^[A-Za-z0-9_.\-/]*/[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,10}"
PATH_REFERENCE = rf"{NAME}[\\/]{NAME}"
#: The prefix owner/name may also follow a reference directly; there its parts have 256 characters at most.
ISSUE_REFERENCE = rf"(?i)(?:#|gh-|(?<!{NAME}){NAME}++/{NAME}++#|\G{NAME}{{1,256}}+/{NAME}{{1,256}}+#|https?://github\.com/{NAME}++/{NAME}++/issues/)(\d+)"
CLOSING_CLAUSE = r"(?i)\b(?:close|closes|closed|closing|fix|fixes|fixed|fixing|resolve|resolves|resolved|resolving)\b([^\n.;]*)"
#: A file name does not begin after a slash, but may with the second character after one.
FILE_NAME = r"(?:(?<![A-Za-z0-9_.\-/\\])|(?<=[/\\][A-Za-z0-9_.-]))[A-Za-z0-9_.-]+\.(?:" + "|".join(SUFFIXES) + r")\b"
NOREPLY = r"(?i)^(?:\d+\+)?([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)@users\.noreply\.github\.com$"
#: Names that say nothing about who has them.
WEAK_NAMES = ("root", "admin", "unknown", "noreply", "user", "github", "git", "ci", "bot", "actions", "renovate", "dependabot")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_regex(pattern: str) -> Column:
    return F.lit(pattern)


def clean_text(c: Column | str) -> Column:
    """Trimmed of white space; empty becomes null."""
    return F.nullif(F.regexp_replace(col(c), r"^\s++|(?<!\s)\s++\z", ""), F.lit(""))


def normalize_value(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def has_real_value(c: Column | str) -> Column:
    """Neither null, empty, nor a text that stands for a missing value."""
    v = normalize_value(c)
    return F.coalesce(v.isNotNull() & ~v.isin(*NOT_REAL), F.lit(False))


def normalize_label(c: Column | str) -> Column:
    """Lower case; hyphens and underscores as spaces, no apostrophes or back-ticks, single spaces."""
    plain = F.translate(F.lower(col(c)), "‘’`“”‐–—", "'''\"\"---")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[-_]", " "), "'", ""), r"\s+", " "))


def parse_labels(c: Column | str) -> Column:
    """Labels, lower-cased and trimmed, without empty ones: of a JSON list, of a list in single quotes, else of text split at | , ;

    Null text has none. A text in brackets that is neither list is split as any other.
    """
    text = F.trim(col(c))
    listed = text.startswith("[") & text.endswith("]")
    as_json = F.from_json(F.when(listed, text), "array<string>")
    # a list in single quotes: items of either quote, in which a backslash may hide the next character
    item = r"""(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")"""
    quoted = listed & text.rlike(rf"^\[\s*+{item}(?:\s*+,\s*+{item})*+\s*+,?+\s*+\]$")
    items = F.transform(F.regexp_extract_all(text, lit_regex(item), F.lit(0)), lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    found = F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(as_json.isNotNull(), as_json).when(quoted, items).otherwise(F.split(text, r"[|,;]"))
    return F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def has_label(labels: Column, wanted: list[str]) -> Column:
    """Exact membership of any normalized wanted label."""
    return F.exists(labels, lambda x: normalize_label(x).isin(*wanted))


def contains_any(labels: Column, keywords: list[str]) -> Column:
    """Any keyword as a substring of the joined labels."""
    blob = F.array_join(labels, " | ")
    found = F.lit(False)
    for k in keywords:
        found = found | blob.contains(k)
    return found


def normalize_name(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " ")), F.lit(""))


def login_as_name(c: Column | str) -> Column:
    return normalize_name(F.regexp_replace(col(c), "[_-]", " "))


def login_of_noreply(c: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(col(c)), NOREPLY, 1)), F.lit(""))


def choose_login(login: Column | str, email: Column | str) -> Column:
    return F.coalesce(normalize_value(login), login_of_noreply(email))


def is_ambiguous_name(name: Column, weak: tuple[str, ...] = WEAK_NAMES) -> Column:
    """Missing, weak, of two characters at most, or one word of three at most."""
    return name.isNull() | name.isin(*weak) | (F.length(name) <= 2) | ((F.size(F.filter(F.split(name, " "), lambda x: x != "")) <= 1) & (F.length(F.trim(name)) <= 3))


def bot_flag(*cols: Column, patterns: tuple[str, ...] = ("[bot]", "bot", "dependabot", "renovate", "github-actions")) -> Column:
    """Any pattern as a substring of any of the lower-cased columns."""
    found = F.lit(False)
    for c in cols:
        for p in patterns:
            found = found | F.coalesce(F.lower(c).contains(p), F.lit(False))
    return found


def _numbers(c: Column) -> Column:
    """Issue numbers of all references in a text; numbers beyond 64 bits are no issue's."""
    return F.filter(F.transform(F.regexp_extract_all(c, lit_regex(ISSUE_REFERENCE), F.lit(1)), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def issue_references(c: Column | str) -> Column:
    """Distinct issue numbers of all references, in order."""
    return F.array_distinct(_numbers(col(c)))


def closing_references(c: Column | str) -> Column:
    """Distinct issue numbers in the tails of closing clauses."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(col(c), lit_regex(CLOSING_CLAUSE), F.lit(1)), _numbers)))


def normalize_mention(c: Column) -> Column:
    """Without punctuation around it; forward slashes, single; no leading ./"""
    after = "['\"`.,;:!?)\\]}>]"
    c = F.regexp_replace(F.trim(c), f"^['\"`(\\[{{<]++|(?<!{after}){after}++$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/"), r"^(?:\./)++", "")


def file_mentions(c: Column | str) -> Column:
    """Distinct mentions: paths, then back-ticked file-like text, then file names."""
    paths = F.filter(F.transform(F.regexp_extract_all(col(c), lit_regex(JOINED), F.lit(0)), lambda x: F.regexp_extract(x, PATH, 0)), lambda x: x != "")
    found = F.concat(paths, F.filter(F.regexp_extract_all(col(c), F.lit("`([^`]{1,300})`"), F.lit(1)), lambda x: x.rlike(r"[/.]") & ~x.rlike(r"\s")), F.regexp_extract_all(col(c), lit_regex(FILE_NAME), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, normalize_mention), lambda x: x != ""))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def clip_snippet(c: Column | str, n: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(col(c), r"[\r\n]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def polarity(c: Column | str, positive=POSITIVE, negative=NEGATIVE, intensifiers=INTENSIFIERS, negators=NEGATORS) -> Column:
    """struct(neg, neu, pos, compound): hits weigh 1.5 after an intensifier and change sides after a negator."""
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    tokens = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), lit_regex(TOKEN), F.lit(0)), lambda t: F.lower(t))

    def hit(t: Column, before: Column) -> Column:
        weight = F.when(F.array_contains(words(intensifiers), before), 1.5).otherwise(1.0)
        side = F.when(F.array_contains(words(positive), t), 1.0).when(F.array_contains(words(negative), t), -1.0).otherwise(0.0)
        return side * weight * F.when(F.array_contains(words(negators), before), -1.0).otherwise(1.0)

    # each token with the one before it; the sums and the result are made once each, as elements of a one-element array
    hits = F.zip_with(F.concat(tokens, F.array(F.lit(""))), F.concat(F.array(F.lit("")), tokens), hit)
    sums = F.aggregate(hits, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n")), lambda s, x: F.struct((s["p"] + F.greatest(x, F.lit(0.0))).alias("p"), (s["n"] - F.least(x, F.lit(0.0))).alias("n")))

    def result(x: Column) -> Column:
        pos, neg = x["p"], x["n"]
        total = pos + neg
        return F.struct(
            F.when(total > 0, neg / total).otherwise(0.0).alias("neg"),
            F.when(total > 0, F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), pos / total + neg / total))).otherwise(1.0).alias("neu"),
            F.when(total > 0, pos / total).otherwise(0.0).alias("pos"),
            F.when(total > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (pos - neg) / (total + 1.0)))).otherwise(0.0).alias("compound"),
        )

    return F.transform(F.array(sums), result)[0]


def text_features(c: Column | str) -> dict[str, Column]:
    """Lengths, counts, ratio of capitals, and flags for code, URLs and paths; null text gives zeros."""
    t = F.coalesce(clean_text(c), F.lit(""))
    letters = F.regexp_count(t, F.lit("[A-Za-z]"))
    return {
        "has_text": (t != "").cast("int"),
        "text_length_chars": F.length(t),
        "token_count": F.regexp_count(t, F.lit(TOKEN)),
        "question_mark_count": F.regexp_count(t, F.lit(r"\?")),
        "exclamation_mark_count": F.regexp_count(t, F.lit("!")),
        "uppercase_ratio": F.when(letters > 0, F.regexp_count(t, F.lit("[A-Z]")) / letters).otherwise(0.0),
        "has_code_block": (t.contains("```") | t.contains("`")).cast("int"),
        "has_url": t.rlike(URL).cast("int"),
        "has_path_reference": t.rlike(PATH_REFERENCE).cast("int"),
    }


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two texts: Jaro with a prefix weight of 0.1 for up to 4 characters. Null and empty texts give 0.

    A character of a matches the first equal one of b, not yet matched, within half of the longer length less one; half of the matches that are in another
    order count as transpositions.
    """
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1, F.lit(0))

    def similarity(x: Column) -> Column:
        s, t, ls, lt = x["s"], x["t"], F.size(x["s"]), F.size(x["t"])

        def match(js: Column, i: Column) -> Column:
            lo, hi = F.greatest(i - x["reach"], F.lit(0)), F.least(i + x["reach"], lt - 1)
            near = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
            return F.concat(js, F.slice(F.filter(near, lambda j: (F.get(t, j) == F.get(s, i)) & ~F.array_contains(js, j)), 1, 1))

        places = F.aggregate(F.sequence(F.lit(0), ls - 1), F.array().cast("array<int>"), match)
        # one-element arrays hold what is used several times
        counted = F.transform(F.array(places), lambda js: F.struct(F.size(js).alias("m"), F.size(F.filter(F.arrays_zip(js.alias("p"), F.array_sort(js).alias("q")), lambda z: F.get(t, z["p"]) != F.get(t, z["q"]))).alias("moved")))
        jaro = F.transform(counted, lambda k: F.when(k["m"] == 0, 0.0).otherwise((k["m"] / ls + k["m"] / lt + (k["m"] - k["moved"] / 2) / k["m"]) / 3))
        prefix = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(4), ls, lt) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get(s, i) == F.get(t, i)), n + 1).otherwise(n))
        return F.transform(jaro, lambda j: j + 0.1 * prefix * (1 - j))[0]

    both = F.array(F.struct(letters(a).alias("s"), letters(b).alias("t"), reach.alias("reach")))
    known = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(known & (a == b), 1.0).when(known, F.transform(both, similarity)[0]).otherwise(0.0)
