"""Secret scan: fixed patterns, and sliding-window entropy for what they miss.

DataFrame functions only.  Base patterns give spans by kind.  The entropy method takes every
maximal run of a character class, moves a window over it with incremental counts and adds the
run when its highest window entropy reaches the threshold of the class, unless an allow-list
pattern covers it or a base span holds it already.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitkit.llm.quality import let


def either_case(word: str) -> str:
    """The word with each letter in either case, ASCII only, in any regular expression dialect."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(
    [*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]
)
ASSIGN = f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # 18 or more characters; a shorter run holds no longer match
HEX = "[0-9a-f]{16,}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    run: str
    alphabet: str
    threshold: float


WINDOW = 20
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", "[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 2.8),
    CharacterClass(
        "entropy_b64",
        "[A-Za-z0-9+/_-]{20,}",
        _LETTERS + _LETTERS.upper() + "0123456789+/_-",
        3.85,
    ),
)
#: Runs that look random but are none: one case of letters only, digits only, UUIDs, paths.
ALLOWED = (
    "^[a-z_-]+$",
    "^[A-Z_-]+$",
    "^[A-Z]?[a-z_-]+$",
    "^[0-9_-]+$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^/?([A-Za-z]+[/_-])+[A-Za-z]*$",
)


def _spans(text: Column, pattern: str, kind: str, good: Column | None = None) -> Column:
    """Spans of all leftmost matches of a pattern, as structs of kind, start and end.

    The text between matches gives their places: a match starts after all earlier pieces and
    matches.  ``good`` is an array of booleans, one a match.
    """

    def placed(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        whole = F.aggregate(
            F.arrays_zip(pieces.alias("p"), found.alias("m")),
            F.struct(
                F.lit(0).alias("at"),
                F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("out"),
            ),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
                F.when(x["m"].isNull(), a["out"])
                .otherwise(
                    F.concat(
                        a["out"],
                        F.array(
                            F.struct(
                                F.lit(kind).alias("kind"),
                                (a["at"] + F.length(x["p"])).alias("start"),
                                (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                            )
                        ),
                    )
                )
                .alias("out"),
            ),
            lambda a: a["out"],
        )
        if good is not None:
            return let(good, lambda g: F.filter(whole, lambda _, i: F.get(g, i)))
        return whole

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)),
    )


def highest_entropy(run: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any window of the run; 0 if it is shorter.

    Counts move along: a step adds the entering and takes out the leaving character, and
    ``s``, the sum of c * log2(c), follows from the two counts that change.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def moved(chars: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            old = F.when(a["i"] >= window, F.get(chars, a["i"] - window))
            into = F.position(x, F.lit(alphabet)) - 1
            gone = F.coalesce(F.position(old, F.lit(alphabet)) - 1, F.lit(-1))
            same = into == gone
            c_in = F.get(a["c"], into)
            c_out = F.coalesce(F.get(a["c"], gone), F.lit(0))
            s = F.when(same, a["s"]).otherwise(
                a["s"]
                + F.get(table, c_in + 1)
                - F.get(table, c_in)
                + F.when(gone >= 0, F.get(table, c_out - 1) - F.get(table, c_out)).otherwise(0.0)
            )
            counts = F.when(same, a["c"]).otherwise(
                F.transform(
                    a["c"],
                    lambda n, k: n + F.when(k == into, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0),
                )
            )
            return F.struct(
                (a["i"] + 1).alias("i"),
                counts.alias("c"),
                s.alias("s"),
                F.when(a["i"] + 1 >= window, F.least(a["low"], s)).otherwise(a["low"]).alias("low"),
            )

        return F.aggregate(
            chars,
            F.struct(
                F.lit(0).alias("i"),
                F.array_repeat(F.lit(0), len(alphabet)).alias("c"),
                F.lit(0.0).alias("s"),
                F.lit(float(window * math.log2(window))).alias("low"),
            ),
            step,
            lambda a: math.log2(window) - a["low"] / window,
        )

    return let(F.filter(F.split(run, ""), lambda c: c != ""), moved)


def _entropy_spans(text: Column, cls: CharacterClass, allowed: tuple[str, ...]) -> Column:
    found = F.regexp_extract_all(text, F.lit(cls.run), F.lit(0))

    def random_looking(run: Column) -> Column:
        fine = F.lit(False)
        for pattern in allowed:
            fine = fine | run.rlike(pattern)
        return F.when(fine, F.lit(False)).otherwise(
            highest_entropy(run, cls.alphabet) >= cls.threshold
        )

    return _spans(text, cls.run, cls.kind, F.transform(found, random_looking))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then by kind as listed."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end")
        ),
    )
    return F.array_join(
        F.transform(
            F.sort_array(keyed),
            lambda s: F.concat_ws(":", F.get(rank, (s["rank"] - 1).cast("int")), s["start"], s["end"]),
        ),
        ",",
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``doc_id, base, found``: arrays of spans (kind, start, end in code points, end exclusive).

    ``base`` has those of the fixed patterns, ``found`` those the entropy method adds.  A null text
    counts as empty and has none.  Repeated rows keep their rows; other columns are not read.
    """

    def base(t: Column) -> Column:
        value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
        return F.concat(
            _spans(t, ASSIGN, "assign", F.transform(value, lambda v: F.length(v) >= 12)),
            F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, "access")).otherwise(
                F.array().cast("array<struct<kind:string,start:int,end:int>>")
            ),
            _spans(t, HEX, "hex"),
        )

    def both(t: Column) -> Column:
        def more(b: Column) -> Column:
            runs = F.concat(*[_entropy_spans(t, c, allowed) for c in CLASSES])
            new = F.filter(
                runs,
                lambda s: ~F.exists(b, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])),
            )
            return F.struct(b.alias("base"), new.alias("found"))

        return let(base(t), more)

    rows = docs.select(F.col(id_col).alias("doc_id"), let(F.coalesce(F.col(text_col), F.lit("")), both).alias("m"))
    return rows.select("doc_id", F.explode(F.array("m")).alias("m")).select("doc_id", "m.base", "m.found")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the joined spans of a scan."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_entropy"),
    )
