"""Strings that stand for a missing value. Results depend on exactly these lists."""

#: In table columns.
COLUMN_NA = (
    "", "-", "−", "--", "---", ".", ",",
    "NA", "na", "n.a.", "N.A.", "n/a", "N/A", "<NA>", "#N/A", "NaN", "nan", "N", "null", "Null", "NULL", "NF",
    "No result", "NOT Found in Database", "No ID", "no data", "unknown", "undefined", "No record", "NIDB",
    "Not available", "TBC", "Internal Standard", "Intstd", "internal standard", "Internal standard",
    "Spiked Stable Isotope Labeled Internal Standards", "Int Std",
)

#: In items of sections, and sample ids.
SCHEMA_NA = (
    "", "-", "−", "--", "---",
    "NA", "na", "n.a.", "N.A.", "n/a", "N/A", "#N/A", "NaN", "nan",
    "null", "Null", "NULL", "none", "None",
    "unspecified", "Unspecified",
)

#: In metabolite names, where NA is a name.
METABOLITE_NA = tuple(v for v in SCHEMA_NA if v != "NA")
