"""Column finders: which columns of a metabolite table mean a standard column, and which values such a column may hold.

The terms and value patterns are fixed values: what is found depends on exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayspark.functions.columns import is_integer, is_numeric, missing, stripped
from assayspark.functions.na import COLUMN_NA

_EDGE = r"[^a-zA-Z0-9]"


def word(term: str) -> str:
    """The term with no letter or digit beside it."""
    return rf"(?:{_EDGE}|^)(?:{term})(?:{_EDGE}|$)"


def listed(element: str, delimiter: str, quoted: bool = False, may_be_empty: bool = False) -> str:
    """Elements with a delimiter after each, which the last may lack; quoted: all of them bare or in equal quotes."""
    if quoted:
        return "(" + "|".join(listed(q + element + q, delimiter, may_be_empty=may_be_empty) for q in ("", "'", '"')) + ")"
    return rf"(({element}\s*{delimiter}\s*){'*' if may_be_empty else '+'}({element}\s*|\s*))"


def any_of(*patterns: str) -> str:
    return "(" + "|".join(patterns) + ")"


def lists(element: str, *delimiters: str) -> tuple[str, ...]:
    """The element, and lists of it with each of the delimiters."""
    return (element, *(listed(element, d) for d in delimiters))


INT, NUM = r"\d+", r"(-?\d*\.\d+|-?\d*\.\d+E(-|\+)?\d+|-?\d+)"
FLOAT, SCIENTIFIC = r"-?\d*\.\d+", r"-?\d*\.\d+E(-|\+)?\d+"
POS_NUM = NUM.replace("-?", "")
POS_FLOAT = r"\d*.\d+"
TIMES = any_of(POS_FLOAT, r"\d", r"\d*\.\d*E(-|\+)?\d+", rf"{POS_FLOAT}\s*(_|-)\s*{POS_FLOAT}", listed(POS_FLOAT, "_"))
PAIR = rf"({POS_FLOAT}(_|@){POS_FLOAT})"
_SYMBOLS = (
    "([BCFHIKNOPSUVWY]|[ISZ][nr]|[ACELP][ru]|A[cglmst]|B[aehikr]|C[adeflos]|D[bsy]|Es|F[elmr]|G[ade]|H[efgos]|Kr|L[aiv]|M[cdgnot]|"
    "N[abdehiop]|O[gs]|P[abdmot]|R[abe-hnu]|S[bcegim]|T[abcehilms]|Xe|Yb"
)
_COUNT = r"([1-9]\d*)*"
ELEMENT = _SYMBOLS + ")" + _COUNT
FORMULA = f"({ELEMENT})+"
_ISOTOPE = _SYMBOLS + "|D)"
ISOTOPIC = any_of(
    _ISOTOPE + _COUNT, rf"\[\d+{_ISOTOPE}\]{_COUNT}", rf"\[\d+\]{_ISOTOPE}{_COUNT}", rf"\[{_ISOTOPE}\d+\]{_COUNT}", rf"{_ISOTOPE}\(\d+\){_COUNT}",
    listed(rf"\d+{_ISOTOPE}{_COUNT}", r"\+"),
) + "+"
FORMULAS = any_of(
    ISOTOPIC.replace(r"\d*", r"\d*\s*"), rf"(\[{FORMULA}\](-|\+)|{FORMULA}(-|\+))", rf"({ELEMENT}|\({FORMULA}\)\d+)+",
    rf"\[{listed(FORMULA, ',', True)}\]", rf"\[{listed(ISOTOPIC, ',', True)}\]",
)
ORGANIC = rf"([CHNOPS]{_COUNT}){{4,}}"
SMILES = r"(\[?\d?[a-zA-Z][a-z]?[0-9@+\-\[\]()\\/%=#$.*" + "\x01\x02\x03\x04" + r"]*)+( \|[0-9:&,w]+\|)?"
INCHIKEY = r"(InChIKey=)?[a-zA-Z]{14}-[a-zA-Z]{10}-[a-zA-Z]?"
INCHI = r"\s*(InChI=)?\d+S?((/c|/h|/i|/t|/m|/s|/q|/f|/p|/b|/[A-Z])(\S)+)+\s*"
_ION = listed(rf"(\d?(m|M)|(-|\+)?\d*{FORMULA}\d*(\((-|\+)\))?|[ \[a-zA-Z]*(A|a)cid|Cat|Chol-head|Hac|\di|FA|NA|A)", r"(-|\+)?")
ION = any_of(f"({_ION})", rf"\[({_ION})\]\(?\d?\s?(-|\+)?\d?\)?", rf"({_ION})\](-|\+)?", rf"\(({_ION})\)((/\d)|(-|\+))?")
KEGG = r"((cpd:)?[CDMGKRZU]0?\d{5}\?{0,2}|(DG|ko)\d{5}|(CA|CE|UP|C)\d{4}|(NA|n/a))"
HMDB = r"((HMDB|HDMB|YMDB|HMBD)\d+(\*|\?)?|n/a)"
HMDB_INT = r"\d{,5}"  # read literally, as RE2 does
LIPID = rf"(LM(PK|ST|GL|FA|SP|GP|PR|SL)[0-9A-Z]{{8,10}}\*?|(ST|FA|PR|GP|PK|GL|SP)\d{{4,6}}-{FORMULA})"
CAS = r"(CAS: ?)?\d+-\d\d-0?\d|\d{1,2}/\d{1,2}/(\d{4}|\d{2})"
IDS = (INT + "[&?]?", *(listed(INT, d) for d in (",", "or", "/", " ", ";")), r"Sum \(\d+ \+ \d+\)", "CID" + INT)


@dataclass(frozen=True)
class Finder:
    """words, all_words: patterns with edges, any one or all of a set; has, all_has: substrings likewise; is_: whole names.
    not_words and not_has exclude. kind: integer, numeric or non-numeric; pattern: what values match as a whole; inverse:
    what they must not match (only without a pattern)."""

    name: str
    words: tuple[str, ...] = ()
    all_words: tuple[tuple[str, ...], ...] = ()
    has: tuple[str, ...] = ()
    all_has: tuple[tuple[str, ...], ...] = ()
    is_: tuple[str, ...] = ()
    not_words: tuple[str, ...] = ()
    not_has: tuple[str, ...] = ()
    kind: str | None = None
    pattern: str | None = None
    inverse: str | None = None

    def names(self, column: Column) -> Column:
        """Whether a column's name (stripped, in lower case) is meant."""
        ways = [column.rlike(word(w)) for w in self.words]
        ways += [column.rlike("".join(f"(?=.*{word(w)})" for w in ws)) for ws in self.all_words]
        ways += [column.contains(w) for w in self.has]
        ways += [reduce(Column.__and__, [column.contains(w) for w in ws]) for ws in self.all_has]
        ways += [column == w for w in self.is_]
        bars = [column.rlike(word(w)) for w in self.not_words] + [column.contains(w) for w in self.not_has]
        return reduce(Column.__and__, [~b for b in bars], reduce(Column.__or__, ways, F.lit(False)))

    def values(self, value: Column, na: tuple[str, ...] = COLUMN_NA, na_matches: bool = True) -> Column:
        """Whether a value may stand in such a column; missing ones may if na_matches."""
        v = stripped(value)
        absent = missing(v, na)
        ok = F.lit(True)
        if self.pattern is not None:
            ok = re2_full_match(self.pattern)(v)
        elif self.inverse is not None:
            ok = ~re2_full_match(self.inverse)(v)
        if self.kind == "integer":
            ok = ok & is_integer(v)
        elif self.kind == "numeric":
            ok = ok & is_numeric(v)
        elif self.kind == "non-numeric":
            ok = ok & ~is_numeric(v)
        return F.when(absent, F.lit(na_matches)).otherwise(F.coalesce(ok, F.lit(False)))


def re2_full_match(pattern: str):
    """A whole-value match with RE2, in linear time for all patterns, over Arrow batches."""

    @F.pandas_udf("boolean")
    def match(values: pd.Series) -> pd.Series:
        return pc.match_substring_regex(pa.array(values, pa.string(), from_pandas=True), rf"\A(?:{pattern})\z").to_pandas()

    return match


def may_hold(standard: Column, value: Column, finders: dict[str, Finder], na: tuple[str, ...] = COLUMN_NA) -> Column:
    """Whether a value may stand in the standard column of that name: Finder.values() for many finders in one pass."""
    patterns = {n: (f.pattern or f.inverse, f.pattern is not None) for n, f in finders.items() if f.pattern is not None or f.inverse is not None}

    @F.pandas_udf("boolean")
    def fits(names: pd.Series, values: pd.Series) -> pd.Series:
        out = pd.Series(True, index=values.index)
        for name, part in values.groupby(names):
            if name in patterns:
                pattern, wanted = patterns[name]
                found = pc.match_substring_regex(pa.array(part, pa.string(), from_pandas=True), rf"\A(?:{pattern})\z").to_pandas()
                out[part.index] = (found if wanted else ~found.astype(bool)).to_numpy()
        return out

    v = stripped(value)
    of = lambda kind: standard.isin(*[n for n, f in finders.items() if f.kind == kind])
    kind = F.when(of("integer"), is_integer(v)).when(of("numeric"), is_numeric(v)).when(of("non-numeric"), ~is_numeric(v)).otherwise(F.lit(True))
    return missing(v, na) | (F.coalesce(fits(standard, F.coalesce(v, F.lit(""))), F.lit(False)) & F.coalesce(kind, F.lit(False)))


NON = "non-numeric"
_NUMBERS = (NUM, listed(NUM, ","))
FINDERS: dict[str, Finder] = {
    f.name: f
    for f in (
        Finder("moverz_quant", words=("m/z", "mz", "moverz", "mx"), not_words=("id",), has=("m.z", "calcmz", "medmz", "m_z", "obsmz", "mass to charge", "mass over z"),
               not_has=("spec", "pectrum", "structure", "regno", "retention"),
               pattern=any_of(*_NUMBERS, listed(NUM, "_"), rf"{NUM}\s*/\s*{NUM}", rf"({NUM}\s*\({NUM}\)\s*;\s*)+({NUM}\s*\({NUM}\)\s*|\s*)", rf"{NUM}(\s*>\s*|\s*<\s*){NUM}", rf"({NUM}\s*)+", rf"{NUM}\s*\(\s*{NUM}\s*\)", rf"{NUM}\s*-\s*{NUM}")),
        Finder("mass", words=("mass", "quantmass", "masses", "mw", "weight"), not_words=("id",), has=("exactmass", "obsmass", "calcmass", "monoisotopicmass", "molwt"),
               not_has=("spec", "pectrum", "structure", "regno", "charge", "over z", "rsd", "m/z"), is_=("m meas.",), pattern=any_of(*_NUMBERS, rf"{NUM}\s*/\s*{NUM}(\s*Da)?", rf"{NUM}\s*-\s*{NUM}")),
        Finder("parent_moverz_quant", is_=("parent",), kind="numeric"),
        Finder("mass_spectrum", has=("spec", "pectrum"), not_has=("species", "composite"), pattern=any_of(rf"({NUM}:{NUM}(_|\s+|$))+", *_NUMBERS)),
        Finder("composite_mass_spectrum", all_has=(("composite", "spectrum"),), not_has=("species",), pattern=rf"((\({listed(NUM, ',')}\)\s*)+)"),
        Finder("inchi_key", has=("inchikey", "inchi-key", "inchi_key", "inchi key"),
               pattern=any_of(INCHIKEY + r"(\*?|\?*)", rf"({INCHIKEY}|null|No record)(\s*or\s*|\s*;\s*|\s*_\s*|\s*&\s*)({INCHIKEY}|null|No record)", rf"Sum\s*\(\s*{INCHIKEY}(\s*\+\s*){INCHIKEY}\s*\)", rf"({INCHIKEY}\s*/\s*)+({INCHIKEY}\s*|\s*)")),
        Finder("inchi", has=("inchi",), not_has=("key",), pattern=any_of(INCHI, rf"\[{listed(INCHI, ',', True)}\]")),
        Finder("smiles", has=("smile",), pattern=any_of(*lists(SMILES, ";"))),
        Finder("formula", has=("formula",), kind=NON, pattern=FORMULAS),
        Finder("compound", has=("compound", "compund"), not_has=("kegg", "formula", "pubchem", "mass", "rt", "algo", "id", "name"), kind=NON),
        Finder("name", has=("name",), all_has=(("name", "refmet"),), not_has=("adduct", "named", "internal", "ion", "metabolite_name"), kind=NON),
        Finder("refmet", has=("refmet",), not_has=("name", "in"), pattern=INT),
        Finder("class", has=("class",), kind=NON, inverse=ORGANIC),
        Finder("pathway", has=("pathway",), not_has=("sort",), kind=NON),
        Finder("pathway_sortorder", all_has=(("pathway", "sort"),), kind="integer"),
        Finder("ion", words=("ion", "ions"), not_has=("adduct", "m/z", "mass"), pattern=any_of(*lists(ION, ",", " "), *_NUMBERS, rf"{NUM}(\s*>\s*|\s*<\s*){NUM}", listed(NUM, "/"))),
        Finder("adduct", has=("adduct",), not_has=("formula",), pattern=any_of(*lists(ION, ",", " ", "_", "(_| )", ""), rf"\[{listed(ION, ',', True)}\]")),
        Finder("species", has=("species",), not_has=("is_species", "ion"), pattern=any_of(*lists(ION, ",", "_"))),
        Finder("pubchem_id", words=("cid",), has=("pubchem",), not_has=("formula", "kegg"), pattern=any_of(*IDS)),
        Finder("kegg_id", has=("kegg",), not_has=("name",), pattern=any_of(*lists(KEGG, ",", ";", "/", "//", "_", "-", "(/|,)", " ", r"(\|)"), f"{KEGG}-{FORMULA}", rf"{KEGG};\d+")),
        Finder("hmdb_id", has=("hmdb", "human metabolome"), all_has=(("hmp", "id"),), not_has=("class",),
               pattern=any_of(HMDB, HMDB_INT, listed(HMDB, ","), listed(HMDB, "/"), listed(HMDB_INT, ","), listed(HMDB_INT, "/"), r"Sum \(HMDB\d+ \+ HMDB\d+\)", listed(HMDB, "&"), listed(HMDB, ";"), listed(HMDB, " "), r"METPA\d+", listed(HMDB, "_"))),
        Finder("lm_id", has=("lipidmaps", "lmid"), all_has=(("lmp", "id"), ("lipid", "map"), ("lm", "id")), pattern=any_of(*lists(LIPID, "_", ",", "/"), INT)),
        Finder("chemspider_id", has=("chemspider",), pattern=any_of(*IDS, "CSID" + INT, *lists(r"[CD]\d{5}", r"\|"))),
        Finder("metlin_id", has=("metlin",), pattern=any_of(INT, "METLIN:" + INT)),
        Finder("cas_number", words=("cas",), pattern=any_of(*lists(CAS, ",", ";"))),
        Finder("binbase_id", words=("bb",), has=("binbase",), pattern=INT),
        Finder("chebi_id", has=("chebi",), pattern=INT),
        Finder("mw_regno", has=("regno",), all_has=(("mw", "structure"),), pattern=any_of(*lists(INT, ","))),
        Finder("mzcloud_id", all_has=(("mz", "cloud", "id"),), pattern=rf"((Reference|Autoprocessed)-)?{INT}"),
        Finder("identifier", has=("identifier", "retention time_m/z", "feature@rt"), not_has=("pubchem", "study", "database"),
               pattern=any_of(PAIR + "(n|m/z)?", f"({INT}_{POS_FLOAT})", *(listed(PAIR, d) for d in ("_", "", "(//|,)")), r"CHEBI:\d+")),
        Finder("other_id", not_words=("cas",), has=("other",), all_has=(("database", "identifier"), ("chemical", "id"), ("cmpd", "id"), ("database", "id"), ("database", "match"), ("local", "id"), ("row", "id"), ("comp", "id"), ("chem", "id"), ("chro", "lib", "id"), ("lib", "id")),
               not_has=("type", "pubchem", "chemspider", "kegg"), is_=("id",), inverse=any_of(FLOAT, SCIENTIFIC)),
        Finder("other_id_type", all_has=(("other", "type"), ("source", "database")), kind=NON),
        Finder("retention_time", words=("rt",), all_words=(("ret", "time"),), has=("rtimes", "r.t.", "medrt", "rtsec", "bestrt", "compoundrt", "rtmed"),
               all_has=(("retention", "time"), ("rentetion", "time"), ("retension", "time")), not_has=("type", "error", "index", "delta", "feature", "m/z"), pattern=TIMES),
        Finder("delta_rt", has=("deltart",), all_has=(("delta", "rt"),), not_has=("type", "error", "index"), pattern=FLOAT + "|0"),
        Finder("retention_index", words=("ri",), all_words=(("ret", "ind"), ("ret", "index")), has=("rindex",), all_has=(("retention", "index"), ("rentetion", "index"), ("reten", "index")),
               not_has=("type", "error"), pattern=TIMES),
        Finder("retention_index_type", all_has=(("retention", "index", "type"), ("ri", "type")), not_has=("error",), kind=NON),
        Finder("abbreviation", has=("abbreviation",), kind=NON),
        Finder("assignment_certainty", all_has=(("assignment", "certainty"),), pattern=INT),
        Finder("comment", has=("comment",), inverse=any_of(FLOAT, SCIENTIFIC, r"\d{2,}")),
        Finder("assignment_method", all_has=(("assignment", "method"),), kind=NON),
        Finder("isotopologue", has=("isotopologue",), all_has=(("isotope", "count"),), not_has=("type",), kind=NON),
        Finder("isotopologue_type", has=("isotopologue%type", "isotope"), not_has=("count",), kind=NON),
        Finder("peak_description", all_has=(("peak", "description"),), kind=NON),
        Finder("peak_pattern", all_has=(("peak", "pattern"),), kind=NON),
        Finder("transient_peak", all_has=(("transient", "peak"),), not_has=("type",), pattern=INT),
        Finder("transient_peak_type", all_has=(("transient", "peak", "type"),), kind=NON),
        Finder("fish_coverage", all_has=(("fish", "coverage"),), pattern=POS_NUM),
        Finder("msi_category", has=("msicategory",), pattern="1"),
        Finder("annotations", not_words=("id",), has=("annotation",), not_has=("source", "approach", "confidence", "level"), kind=NON),
        Finder("istd", has=("internal",), is_=("istd",), kind=NON),
        Finder("platform", has=("platform",), kind=NON),
        Finder("ms_method", has=("method",), not_has=("assignment",), kind=NON),
        Finder("polarity", has=("polarity",), pattern=r"(?i)((neg|pos|1|-1|\+|positive|negative)|\[M\+H\]\+|\[M-H\]-|5MM\+|5MM-)"),
        Finder("esi_mode", has=("esi",), pattern=r"(neg|pos|1|-1|(ESI )?\(\+\)( ESI)?|(ESI )?\(-\)( ESI| ES\))?|positive|negative)"),
        Finder("ionization_mode", all_words=(("pos", "neg"),), has=("ionization", "ionisation"), not_has=("confirmed",), is_=("mode", "ms mode"), pattern=r"(?i)((neg|pos|1|-1|(ES)?\+|(ES)?-|positive|negative|TOF|Splitless|Split30))"),
        Finder("frequency", has=("frequency",), pattern=INT),
    )
}

