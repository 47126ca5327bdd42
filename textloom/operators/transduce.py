"""DOM12-16: aligning a romanisation with its source word, letter by letter.

``transduce`` walks both texts once and succeeds only if both are used up. It is a
pandas UDF because the walk has state; everything around it is built-in.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions.text import CONSONANTS

# Romanised letters that may stand for a consonant.
COMPATIBLE = {
    "س": ("s",), "ص": ("s", "ṣ"), "ث": ("s", "s̱", "th"),
    "ز": ("z",), "ض": ("z", "ż", "ḍ"), "ظ": ("z", "ẓ"), "ذ": ("z", "ẕ", "dh"),
    "ه": ("h",), "ح": ("h", "ḥ"), "ت": ("t",), "ط": ("t", "ṭ"),
    "ق": ("q", "gh", "ġ", "ğ"), "غ": ("gh", "ġ", "ğ", "q"), "خ": ("kh", "x"), "ک": ("k",), "گ": ("g",),
    "ش": ("sh", "š"), "چ": ("ch", "č"), "ژ": ("zh", "ž"), "ج": ("j", "dj"),
    "ب": ("b",), "پ": ("p",), "ف": ("f",), "د": ("d",), "ر": ("r",), "ل": ("l",), "م": ("m",), "ن": ("n",),
    "و": ("v", "w"), "ی": ("y", "j"),
}
# Tags of the two varieties.
CLASSICAL_TAGS = ("classical-persian", "classical", "early-classical-persian", "dari", "hazaragi")
IRANIAN_TAGS = ("iranian-persian", "iranian", "tehrani", "standard-iranian", "iran")
LONG_A, APOSTROPHES, HAMZA = "âā", "ʿʾʼ’'`", "ءأإؤئ"
#: Short vowels by profile; a letter that is missing fails.
SHORT = {"IRANIAN": {"a": "a", "e": "i", "o": "u"}, "CLASSICAL_DARI": {"a": "a", "i": "i", "u": "u"}}
DIPHTHONG = {"IRANIAN": {"و": ("ow",), "ی": ("ey", "ay")}, "CLASSICAL_DARI": {"و": ("aw",), "ی": ("ay",)}}


class _Walk:
    def __init__(self, word: str, roman: str, profile: str):
        self.w, self.r, self.p, self.i, self.j, self.out = word, roman, profile, 0, 0, []

    def take(self, options, output: str | None = None) -> bool:
        for option in sorted(options, key=len, reverse=True):
            if self.r.startswith(option, self.j):
                self.j += len(option)
                self.out.append(option if output is None else output)
                return True
        return False

    def short_vowel(self) -> bool:
        """An unwritten vowel, unless it belongs to the letter that follows; False if the profile has no such vowel."""
        v = self.r[self.j : self.j + 1]
        if v not in ("a", "e", "i", "o", "u"):
            return True
        follow = self.w[self.i : self.i + 1]
        if follow in ("و", "ی"):
            if any(self.r.startswith(d, self.j) for d in DIPHTHONG[self.p][follow]) or v == ("u" if follow == "و" else "i"):
                return True
        if follow == "ا" and v == "a" and self.p == "CLASSICAL_DARI":
            return True
        if v not in SHORT[self.p]:
            return False
        self.j += 1
        self.out.append(SHORT[self.p][v])
        return True

    def glide(self, c: str) -> bool:
        long, plain, cons = ("ū", "u", "vw") if c == "و" else ("ī", "i", "yj")
        if self.take(DIPHTHONG[self.p][c], "aw" if c == "و" else "ay"):
            return True
        if self.r[self.j : self.j + 1] in (long, plain):
            self.j += 1
            self.out.append(long)
            return True
        if self.r[self.j : self.j + 1] and self.r[self.j] in cons:
            self.out.append(self.r[self.j] if c == "و" else "y")
            self.j += 1
            return self.short_vowel()
        return False

    def run(self) -> str | None:
        while self.i < len(self.w):
            c, first = self.w[self.i], self.i == 0
            self.i += 1
            if c == "آ":
                if not self.take((*LONG_A, "a"), "ā"):
                    return None
            elif c == "ا" and first:
                follow = self.w[self.i : self.i + 1]
                if follow in ("و", "ی") and (any(self.r.startswith(d, self.j) for d in DIPHTHONG[self.p][follow]) or self.r[self.j : self.j + 1] in ("ū", "ī")):
                    continue
                at = self.j
                if not self.short_vowel() or self.j == at and not (follow in ("و", "ی") and self.r[self.j : self.j + 1] in ("u", "i")):
                    return None
            elif c == "ا":
                if not self.take((*LONG_A, "a"), "ā"):
                    return None
            elif c == "ع" or c in HAMZA:
                self.out.append("ʿ" if c == "ع" else "ʾ")
                if self.r[self.j : self.j + 1] and self.r[self.j] in APOSTROPHES:
                    self.j += 1
                if not self.short_vowel():
                    return None
            elif c in ("و", "ی"):
                if not self.glide(c):
                    return None
            elif c in COMPATIBLE:
                if not self.take(COMPATIBLE[c], CONSONANTS[c]) or not self.short_vowel():
                    return None
            else:
                return None
        return "".join(self.out) if self.j == len(self.r) else None


def transduce(word: str | None, roman: str | None, profile: str | None) -> tuple[str, str | None]:
    """(status, canonical form)."""
    if profile not in SHORT:
        return "PROFILE_NOT_USABLE", None
    if not roman:
        return "NO_ROMANIZATION", None
    clean = unicodedata.normalize("NFC", (word or "").replace("‌", "").replace("‍", ""))
    low = unicodedata.normalize("NFC", roman.replace("‌", "").replace("‍", "")).strip().lower()
    if "ē" in low or "ō" in low:
        return "MAJHUL_VOWEL", None
    if clean[-1:] in ("ه", "ۀ") and low[-1:] in ("e", "a"):
        return "SILENT_HEH", None
    result = _Walk(clean, low, profile).run() if clean else None
    if result is None:
        return "NOT_ALIGNED", None
    return ("DIRECT" if result == low else "DETERMINISTIC"), result


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("canonical", StringType())]))
def transduced(word: pd.Series, roman: pd.Series, profile: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([transduce(*x) for x in zip(word, roman, profile)], columns=["status", "canonical"])


def profile_of(tags: Column) -> Column:
    """DOM14: profile from variety tags; both kinds conflict."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    iranian = F.arrays_overlap(low, F.array(*map(F.lit, IRANIAN_TAGS)))
    classical = F.arrays_overlap(low, F.array(*map(F.lit, CLASSICAL_TAGS)))
    return F.when(F.coalesce(iranian & classical, F.lit(False)), "CONFLICTING").when(iranian, "IRANIAN").when(classical, "CLASSICAL_DARI").otherwise("UNCLASSIFIED")


# Arguments of a template that say nothing.
NO_ARGUMENT = ("", "-", "—", "―", "+", "?", "none", "n/a", "null", "undefined", "--")
#: Tiers in order of precedence.
TIERS = ("TIER_A_EXPLICIT", "TIER_B_STRUCTURAL", "TIER_C_PAIRED")


def recover_profiles(rows: DataFrame, rules: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """DOM15/JON16: profiles of romanisations by three tiers of evidence; the first tier that says anything decides.

    ``rows``: record_id, form, etymology, head, idx (of a record's romanisations), romanization, profile; optionally ``templates``, an
    array of (name, args map). Tier A: the profile that the tags give; contradictory tags are a conflict. Tier B: the first
    template, then the first of ``rules`` (template, argument, profile), whose argument is the romanisation and aligns with the form
    in that profile. Tier C: of two romanisations of one record and form without other evidence, whose etymologies and heads do not
    differ, one can be Iranian and the other classical, and not the other way round; partners that disagree are a conflict.

    Adds effective_profile, status (EXPLICIT, RECOVERED, CONFLICTING, UNRECOVERABLE), tier, partners (idx of tier C, sorted) and
    recovery_id. Pairs are made of one record's open romanisations only.
    """
    low = F.lower(F.trim("romanization"))
    ok = lambda profile: transduced(F.col("form"), F.trim("romanization"), F.lit(profile))["canonical"].isNotNull()
    found = rows.withColumns({"_i": ok("IRANIAN"), "_c": ok("CLASSICAL_DARI")})
    structural = F.lit(None).cast("string")
    if rules and "templates" in rows.columns:
        rule_rows = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(p).alias("p")) for t, a, p in rules))
        holds = lambda t, r: (F.trim(t["name"]) == r["t"]) & (F.trim(F.try_element_at(t["args"], r["a"])) == F.trim("romanization")) & ~low.isin(*NO_ARGUMENT) & F.when(r["p"] == "IRANIAN", F.col("_i")).otherwise(F.col("_c"))
        hits = F.flatten(F.transform("templates", lambda t: F.transform(F.filter(rule_rows, lambda r: F.coalesce(holds(t, r), F.lit(False))), lambda r: r["p"])))
        structural = F.try_element_at(hits, F.lit(1))
    explicit = F.when(F.col("profile").isin("IRANIAN", "CLASSICAL_DARI", "CONFLICTING"), F.col("profile"))
    found = found.withColumns({"_a": explicit, "_b": F.when(explicit.isNull(), structural)})

    open_ = found.where("_a IS NULL AND _b IS NULL AND romanization IS NOT NULL AND trim(romanization) <> ''")
    place = ["record_id", "form", "idx"]
    a, b = open_.alias("a"), open_.alias("b")
    agrees = lambda k: F.col(f"a.{k}").isNull() | F.col(f"b.{k}").isNull() | (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, [F.col("a.record_id") == F.col("b.record_id"), F.col("a.form") == F.col("b.form"), F.col("a.idx") < F.col("b.idx"), F.col("a.romanization") != F.col("b.romanization"), agrees("etymology"), agrees("head")])
    iranian = lambda s: F.col(f"{s}._i") & ~F.lower(f"{s}.romanization").rlike("[āīūēō]")
    classical = lambda s: F.col(f"{s}._c") & ~F.lower(f"{s}.romanization").rlike("[â]|ey|ow")
    judged = pairs.select(
        "a.record_id", "a.form", F.col("a.idx").alias("ia"), F.col("b.idx").alias("ib"), (iranian("a") & classical("b")).alias("ab"), (iranian("b") & classical("a")).alias("ba")
    ).where("ab <> ba")
    side = lambda me, other, first: F.struct(F.col(me).alias("idx"), F.col(other).alias("partner"), F.when(F.col(first), "IRANIAN").otherwise("CLASSICAL_DARI").alias("p"))
    votes = judged.select("record_id", "form", F.explode(F.array(side("ia", "ib", "ab"), side("ib", "ia", "ba"))).alias("v")).select("record_id", "form", "v.*")
    votes = votes.groupBy(*place).agg(F.min("p").alias("_p"), F.max("p").alias("_q"), F.array_sort(F.collect_set("partner")).alias("partners"))

    out = found.join(votes, place, "left")
    paired = F.when(F.col("_p") == F.col("_q"), F.col("_p")).when(F.col("_p").isNotNull(), "CONFLICTING")
    profile = F.coalesce("_a", "_b", paired)
    tier = F.when(F.col("_a").isNotNull(), TIERS[0]).when(F.col("_b").isNotNull(), TIERS[1]).when(F.col("_p").isNotNull(), TIERS[2])
    status = F.when(profile.isNull(), "UNRECOVERABLE").when(profile == "CONFLICTING", "CONFLICTING").when(F.col("_a").isNotNull(), "EXPLICIT").otherwise("RECOVERED")
    basis = F.concat_ws("\u0000", F.col("record_id").cast("string"), "form", F.col("idx").cast("string"), F.coalesce(profile, F.lit("UNCLASSIFIED")), F.coalesce(tier, F.lit("NONE")), F.array_join("partners", ","))
    return out.select(*rows.columns, F.coalesce(profile, F.col("profile")).alias("effective_profile"), status.alias("status"), tier.alias("tier"), "partners", F.concat(F.lit("rec-"), F.substring(F.sha2(basis, 256), 1, 16)).alias("recovery_id"))
