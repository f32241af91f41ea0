"""Item names in Thai and Latin script: a canonical token set, and a similarity of two names.

Everything is a Column expression. Normalise each distinct name once and keep it before comparing pairs: the
expressions are long, and lambdas run outside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, strengths and dosage forms that are no part of a name.
DOSE_WORDS = [
    "mg", "mcg", "ug", "µg", "g", "ml", "cc", "iu", "unit", "units", "tab", "tabs", "tabcap", "cap", "caps",
    "tablet", "tablets", "capsule", "capsules", "suspension", "solution", "injection", "injections", "syrup", "cream",
    "gel", "ointment", "drops", "drop", "lotion", "powder", "suppository", "susp", "sol", "inj", "syr",
    "มิลลิกรัม", "ไมโครกรัม", "มิลลิลิตร", "กรัม", "ลิตร", "ยูนิต", "หน่วย", "เปอร์เซ็นต์", "มก", "มล",
    "เม็ด", "แคปซูล", "ยาเม็ด", "ยาน้ำ", "ยาฉีด", "น้ำเชื่อม", "ครีม", "เจล", "ขี้ผึ้ง", "แผ่น", "หลอด", "แท็บเล็ต", "หยด",
]
#: Score from which a match may be applied without review.
AUTO_SCORE = 0.95
#: Longest search term that a suggestion asks the catalog for.
TERM_CHARS = 16

_TOKEN = "[0-9]+|[๐-๙]+|[ก-๏]+|[\\p{IsAlphabetic}\\p{N}&&[^0-9ก-๿]]+"
_NUMBER = "^[0-9๐-๙]+$"
_SPACE = r"^[\s\p{Z}]*$"


def _kept(token: Column) -> Column:
    return ~token.rlike(_NUMBER) & ~token.isin(DOSE_WORDS)


def tokens(text: Column) -> Column:
    """Maximal runs of one class: ASCII digits, Thai digits, Thai letters and marks, other letters and digits."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), 0)


def is_dose(text: Column) -> Column:
    """Whether a bracket's content says nothing but a strength, unit or form."""
    return ~text.rlike(_SPACE) & F.forall(tokens(text), lambda t: ~_kept(t))


def open_brackets(text: Column) -> Column:
    """Brackets resolved from left to right: a bracket's content stays, set off by a space, unless it is a dose.

    A bracket within a bracket starts the content anew; one that never closes leaves its content; a closing one
    without an opening one stays.
    """
    state = lambda out, held, depth: F.struct(out.alias("out"), held.alias("held"), depth.alias("depth"))

    def step(s: Column, c: Column) -> Column:
        shut = (c == ")") & (s["depth"] > 0)
        flushed = F.when(is_dose(s["held"]), s["out"]).otherwise(F.concat(s["out"], F.lit(" "), s["held"]))
        return (
            F.when(c == "(", state(s["out"], F.lit(""), s["depth"] + 1))
            .when(shut, state(flushed, F.lit(""), s["depth"] - 1))
            .when(s["depth"] > 0, state(s["out"], F.concat(s["held"], c), s["depth"]))
            .otherwise(state(F.concat(s["out"], c), s["held"], s["depth"]))
        )

    resolved = F.aggregate(F.split(text, ""), state(F.lit(""), F.lit(""), F.lit(0)), step, lambda s: F.concat(s["out"], s["held"]))
    return F.when(text.contains("(") | text.contains(")"), resolved).otherwise(text)


def one_spelling(text: Column) -> Column:
    """Spellings of the doubled and the vowelled letter ro, brought to one in a single pass from left to right.

    Private-use marks keep what one rule has made from being read by another.
    """
    made, shut = "\ue000", "\ue001"
    marked = F.regexp_replace(text, "ร(?:ร|(ึ)|า(?![ะ-๏]))", f"ร{made}$1{shut}")
    return F.regexp_replace(F.regexp_replace(marked, f"{made}ึ{shut}", "ิ"), f"[{made}{shut}]", "")


def normalized(name: Column) -> Column:
    """The sorted distinct tokens of a name that are neither numbers nor doses, joined by spaces."""
    found = tokens(one_spelling(open_brackets(F.lower(F.coalesce(name, F.lit(""))))))
    return F.array_join(F.array_distinct(F.array_sort(F.filter(found, _kept))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens of two normalised names."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def similarity_normalized(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal; with common tokens 0.5 to 1 by their share, else by edit distance."""
    share = jaccard(a, b)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(share > 0, 0.5 + 0.5 * share)
        .otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)))
    )


def similarity(a: Column, b: Column) -> Column:
    return similarity_normalized(normalized(a), normalized(b))


def search_term(name: Column) -> Column:
    """The first word, with the second if the first has under three characters, cut to TERM_CHARS; blank gives ''."""
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"[\s\p{Z}]+"), lambda w: w != "")
    first, second = F.coalesce(F.get(words, 0), F.lit("")), F.get(words, 1)
    term = F.when((F.char_length(first) < 3) & second.isNotNull(), F.concat_ws(" ", first, second)).otherwise(first)
    return F.substring(term, 1, TERM_CHARS)


def escape_like(term: Column) -> Column:
    """For LIKE ... ESCAPE '~' against a database; on Spark tables use contains()."""
    return F.regexp_replace(term, "([~%_])", "~$1")
