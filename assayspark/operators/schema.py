"""Schema rules as a table: which sections and keys a document must have and what their values may be (check 24).

Rules are rows of (section, key, keyword, argument, severity, message), so other rules are other rows; from_json_schema()
makes them from a JSON Schema of a document; one of any depth is read by schema_tree. A document is held against the rules of its method (MS, or NMR with an NM
section) and of any method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.functions.columns import missing
from assayspark.functions.finders import NUM
from assayspark.functions.na import SCHEMA_NA
from assayspark.model import HEADER, Tables

RULE = "method string, section string, key string, keyword string, argument string, severity string, message string"
ANY, MS, NMR = "any", "MS", "NMR"
_RANGE = rf"{NUM}(-|\sto\s|−){NUM}"
#: The tags of each keyword. Fixed values.
TAGS = {"additionalProperties": "format", "required": "format", "minProperties": "format", "minLength": "value", "maxLength": "value", "enum": "value", "format": "value", "pattern": "value", "minimum": "value", "maximum": "value", "not": "value"}
EMAIL = r"@"
_MORE = " A longer description may say what a number can't."

# What follows down to CHOICES are fixed values.
#: Sections that a document must have, with the keys that they must have.
REQUIRED = {
    HEADER: ("VERSION", "CREATED_ON"),
    "PROJECT": ("PROJECT_TITLE", "PROJECT_SUMMARY", "INSTITUTE", "LAST_NAME", "FIRST_NAME", "ADDRESS", "EMAIL", "PHONE"),
    "STUDY": ("STUDY_TITLE", "STUDY_SUMMARY", "INSTITUTE", "LAST_NAME", "FIRST_NAME", "ADDRESS", "EMAIL", "PHONE"),
    "SUBJECT": ("SUBJECT_TYPE", "SUBJECT_SPECIES"),
    "COLLECTION": ("COLLECTION_SUMMARY",),
    "TREATMENT": ("TREATMENT_SUMMARY",),
    "SAMPLEPREP": ("SAMPLEPREP_SUMMARY",),
    "ANALYSIS": ("ANALYSIS_TYPE",),
}
#: The same for documents of one method; CHROMATOGRAPHY may be missing as a whole.
REQUIRED_BY_METHOD = {
    MS: {"MS": ("INSTRUMENT_NAME", "INSTRUMENT_TYPE", "MS_TYPE", "ION_MODE")},
    NMR: {"NM": ("INSTRUMENT_NAME", "INSTRUMENT_TYPE", "NMR_EXPERIMENT_TYPE", "SPECTROMETER_FREQUENCY")},
}
REQUIRED_IF_THERE = {
    "CHROMATOGRAPHY": ("CHROMATOGRAPHY_TYPE", "INSTRUMENT_NAME", "COLUMN_NAME", "FLOW_GRADIENT", "FLOW_RATE", "COLUMN_TEMPERATURE", "SOLVENT_A", "SOLVENT_B"),
    "MS_METABOLITE_DATA": ("Units",), "NMR_METABOLITE_DATA": ("Units",), "NMR_BINNED_DATA": ("Units",),
}
#: Keys whose values are a number and one of the units.
UNITS = {
    "SUBJECT": {"AGE_OR_AGE_RANGE": ("weeks", "days", "months", "years"), "WEIGHT_OR_WEIGHT_RANGE": ("g", "mg", "kg", "lbs"), "HEIGHT_OR_HEIGHT_RANGE": ("cm", "in")},
    "TREATMENT": {"TREATMENT_DOSEDURATION": ("h", "weeks", "days"), "PLANT_TEMP": ("°C", "C")},
    "CHROMATOGRAPHY": {
        "FLOW_RATE": ("mL/min", "uL/min", "μL/min"), "COLUMN_TEMPERATURE": ("°C", "C"), "SAMPLE_INJECTION": ("μL", "uL"), "COLUMN_PRESSURE": ("psi", "bar"), "ANALYTICAL_TIME": ("min",),
        "CAPILLARY_VOLTAGE": ("V", "kV"), "RUNNING_VOLTAGE": ("V", "kV"), "TRANSFERLINE_TEMPERATURE": ("°C", "C"), "WEAK_WASH_VOLUME": ("μL", "uL"), "STRONG_WASH_VOLUME": ("μL", "uL"),
        "TARGET_SAMPLE_TEMPERATURE": ("°C", "C"), "SAMPLE_LOOP_SIZE": ("μL", "uL"), "SAMPLE_SYRINGE_SIZE": ("μL", "uL"),
    },
    "MS": {
        "CAPILLARY_TEMPERATURE": ("°C", "C"), "CAPILLARY_VOLTAGE": ("V", "kV"), "DRY_GAS_FLOW": ("L/hr", "L/min"), "DRY_GAS_TEMP": ("°C", "C"), "FRAGMENT_VOLTAGE": ("V",),
        "GAS_PRESSURE": ("psi", "psig", "bar", "kPa"), "HELIUM_FLOW": ("mL/min",), "ION_SOURCE_TEMPERATURE": ("°C", "C"), "ION_SPRAY_VOLTAGE": ("V", "kV"), "IONIZATION_ENERGY": ("eV",),
        "SOURCE_TEMPERATURE": ("°C", "C"), "SPRAY_VOLTAGE": ("kV",), "ACTIVATION_TIME": ("ms",), "DESOLVATION_GAS_FLOW": ("L/hr", "L/min"), "DESOLVATION_TEMPERATURE": ("°C", "C"),
        "OCTPOLE_VOLTAGE": ("V",), "SKIMMER_VOLTAGE": ("V",),
    },
    "NM": {
        "STANDARD_CONCENTRATION": ("mM",), "SPECTROMETER_FREQUENCY": ("MHz",), "POWER_LEVEL": ("W", "dB"), "OFFSET_FREQUENCY": ("ppm", "Hz"), "PRESATURATION_POWER_LEVEL": ("W", "dB"),
        "TEMPERATURE": ("°C", "C", "K"), "ACQUISITION_TIME": ("s",), "RELAXATION_DELAY": ("s", "ms", "us", "μs"), "SPECTRAL_WIDTH": ("ppm", "Hz"), "LINE_BROADENING": ("Hz",), "BINNED_INCREMENT": ("ppm",),
    },
}
#: Those of them that may hold a range too.
RANGES = (
    "AGE_OR_AGE_RANGE", "WEIGHT_OR_WEIGHT_RANGE", "HEIGHT_OR_HEIGHT_RANGE", "TREATMENT_DOSEDURATION", "PLANT_TEMP",
    "FLOW_RATE", "COLUMN_TEMPERATURE", "COLUMN_PRESSURE", "ANALYTICAL_TIME", "CAPILLARY_TEMPERATURE",
)
#: Other patterns, which are searched for.
PATTERNS = {
    HEADER: {"STUDY_ID": r"^ST\d{6}$", "ANALYSIS_ID": r"^AN\d{6}$", "VERSION": r"^\d+$", "PROJECT_ID": r"^PR\d{6}$", "DATATRACK_ID": r"^\d+$"},
    "PROJECT": {"DOI": r"10\.\d{4,9}/[-._;()/:a-z0-9A-Z]+"},
    "SUBJECT": {"TAXONOMY_ID": r"((\d+\s*(,|;|\||/)\s*)*(\d+\s*|\s*))", "GENDER": r"^((?i:male)|(?i:female)|(?i:male, female)|(?i:hermaphrodite)|N/A)$"},
    "COLLECTION": {"BLOOD_SERUM_OR_PLASMA": r"(?i)^(blood|plasma|serum)$"},
    "CHROMATOGRAPHY": {"INJECTION_TEMPERATURE": rf"^(({_RANGE}|{NUM}) (°C|C))|(?i:room temperature)$"},
    "MS": {"ION_MODE": r"(?i)^(positive|negative|positive, negative|unspecified)$", "COLLISION_GAS": r"(?i)^(nitrogen|argon)$"},
    "NM": {"RECEIVER_GAIN": r"^((\d+)|(\d*\.\d+))$", "NUMBER_OF_SCANS": r"^\d+$", "NUM_DATA_POINTS_ACQUIRED": r"^\d+$"},
}
#: Keys whose values may not match.
NOT_PATTERNS = {"MS": {"IONIZATION": r"(?i)^(pos|neg|positive|negative|postive|both)$"}}
CHOICES = {"ANALYSIS": {"ANALYSIS_TYPE": ("MS", "NMR")}}
EMAILS = {"PROJECT": "EMAIL", "STUDY": "EMAIL"}

#: Keys that a section may have beside those above; what is in neither is not known.
FREE = {
    HEADER: "HEADER filename",
    "PROJECT": "PROJECT_TYPE DEPARTMENT LABORATORY FUNDING_SOURCE PROJECT_COMMENTS PUBLICATIONS CONTRIBUTORS",
    "STUDY": "STUDY_TYPE DEPARTMENT LABORATORY SUBMIT_DATE NUM_GROUPS TOTAL_SUBJECTS NUM_MALES NUM_FEMALES STUDY_COMMENTS PUBLICATIONS",
    "SUBJECT": """GENOTYPE_STRAIN HUMAN_RACE HUMAN_ETHNICITY HUMAN_TRIAL_TYPE HUMAN_LIFESTYLE_FACTORS HUMAN_MEDICATIONS HUMAN_PRESCRIPTION_OTC HUMAN_SMOKING_STATUS
        HUMAN_ALCOHOL_DRUG_USE HUMAN_NUTRITION HUMAN_INCLUSION_CRITERIA HUMAN_EXCLUSION_CRITERIA ANIMAL_ANIMAL_SUPPLIER ANIMAL_HOUSING ANIMAL_LIGHT_CYCLE ANIMAL_FEED ANIMAL_WATER
        ANIMAL_INCLUSION_CRITERIA CELL_BIOSOURCE_OR_SUPPLIER CELL_STRAIN_DETAILS SUBJECT_COMMENTS CELL_PRIMARY_IMMORTALIZED CELL_PASSAGE_NUMBER CELL_COUNTS SPECIES_GROUP""",
    "COLLECTION": """SAMPLE_TYPE COLLECTION_METHOD COLLECTION_LOCATION COLLECTION_FREQUENCY COLLECTION_DURATION COLLECTION_TIME VOLUMEORAMOUNT_COLLECTED STORAGE_CONDITIONS
        COLLECTION_VIALS STORAGE_VIALS COLLECTION_TUBE_TEMP ADDITIVES TISSUE_CELL_IDENTIFICATION TISSUE_CELL_QUANTITY_TAKEN""",
    "TREATMENT": """TREATMENT TREATMENT_COMPOUND TREATMENT_ROUTE TREATMENT_DOSE TREATMENT_DOSEVOLUME TREATMENT_VEHICLE ANIMAL_VET_TREATMENTS ANIMAL_ANESTHESIA
        ANIMAL_ACCLIMATION_DURATION ANIMAL_FASTING ANIMAL_ENDP_EUTHANASIA ANIMAL_ENDP_TISSUE_COLL_LIST ANIMAL_ENDP_TISSUE_PROC_METHOD ANIMAL_ENDP_CLINICAL_SIGNS HUMAN_FASTING
        HUMAN_ENDP_CLINICAL_SIGNS CELL_STORAGE CELL_GROWTH_CONTAINER CELL_GROWTH_CONFIG CELL_GROWTH_RATE CELL_INOC_PROC CELL_MEDIA CELL_ENVIR_COND CELL_HARVESTING PLANT_GROWTH_SUPPORT
        PLANT_GROWTH_LOCATION PLANT_PLOT_DESIGN PLANT_LIGHT_PERIOD PLANT_HUMIDITY PLANT_WATERING_REGIME PLANT_NUTRITIONAL_REGIME PLANT_ESTAB_DATE PLANT_HARVEST_DATE PLANT_GROWTH_STAGE
        PLANT_METAB_QUENCH_METHOD PLANT_HARVEST_METHOD PLANT_STORAGE CELL_PCT_CONFLUENCE CELL_MEDIA_LASTCHANGED""",
    "SAMPLEPREP": """PROCESSING_METHOD PROCESSING_STORAGE_CONDITIONS EXTRACTION_METHOD EXTRACT_CONCENTRATION_DILUTION EXTRACT_ENRICHMENT EXTRACT_CLEANUP EXTRACT_STORAGE SAMPLE_RESUSPENSION
        SAMPLE_DERIVATIZATION SAMPLE_SPIKING ORGAN ORGAN_SPECIFICATION CELL_TYPE SUBCELLULAR_LOCATION""",
    "CHROMATOGRAPHY": """CHROMATOGRAPHY_SUMMARY METHODS_FILENAME METHODS_ID INTERNAL_STANDARD INTERNAL_STANDARD_MT RETENTION_INDEX RETENTION_TIME SAMPLING_CONE MIGRATION_TIME
        OVEN_TEMPERATURE PRECONDITIONING RUNNING_BUFFER SHEATH_LIQUID TIME_PROGRAM WASHING_BUFFER WEAK_WASH_SOLVENT_NAME STRONG_WASH_SOLVENT_NAME RANDOMIZATION_ORDER CHROMATOGRAPHY_COMMENTS""",
    "ANALYSIS": """LABORATORY_NAME ACQUISITION_DATE SOFTWARE_VERSION OPERATOR_NAME DETECTOR_TYPE ANALYSIS_PROTOCOL_FILE ACQUISITION_PARAMETERS_FILE PROCESSING_PARAMETERS_FILE DATA_FORMAT
        ACQUISITION_ID ACQUISITION_TIME ANALYSIS_COMMENTS ANALYSIS_DISPLAY INSTRUMENT_NAME INSTRUMENT_PARAMETERS_FILE NUM_FACTORS NUM_METABOLITES PROCESSED_FILE RANDOMIZATION_ORDER RAW_FILE""",
    "MS": """COLLISION_ENERGY FRAGMENTATION_METHOD IONIZATION_POTENTIAL MASS_ACCURACY PRECURSOR_TYPE REAGENT_GAS ACTIVATION_PARAMETER ATOM_GUN_CURRENT AUTOMATIC_GAIN_CONTROL BOMBARDMENT
        CDL_SIDE_OCTOPOLES_BIAS_VOLTAGE CDL_TEMPERATURE DATAFORMAT INTERFACE_VOLTAGE IT_SIDE_OCTOPOLES_BIAS_VOLTAGE LASER MATRIX NEBULIZER PROBE_TIP RESOLUTION_SETTING SAMPLE_DRIPPING
        SCAN_RANGE_MOVERZ SCANNING SCANNING_CYCLE SCANNING_RANGE TUBE_LENS_VOLTAGE MS_COMMENTS MS_RESULTS_FILE""",
    "NM": """NMR_COMMENTS FIELD_FREQUENCY_LOCK NMR_PROBE NMR_SOLVENT NMR_TUBE_SIZE SHIMMING_METHOD PULSE_SEQUENCE WATER_SUPPRESSION PULSE_WIDTH CHEMICAL_SHIFT_REF_CPD DUMMY_SCANS
        REAL_DATA_POINTS ZERO_FILLING APODIZATION BASELINE_CORRECTION_METHOD CHEMICAL_SHIFT_REF_STD BINNED_DATA_NORMALIZATION_METHOD BINNED_DATA_PROTOCOL_FILE
        BINNED_DATA_CHEMICAL_SHIFT_RANGE BINNED_DATA_EXCLUDED_RANGE NMR_RESULTS_FILE""",
}
#: Sections that name a protocol, its file and comments.
WITH_PROTOCOL = ("COLLECTION", "TREATMENT", "SAMPLEPREP")
#: Sections that a document of one method may have beside those that it must have.
MAY_HAVE = {MS: ("MS_METABOLITE_DATA", "CHROMATOGRAPHY"), NMR: ("NMR_METABOLITE_DATA", "NMR_BINNED_DATA")}


def known_keys() -> dict[str, list[str]]:
    """The keys that each section may have: all that a rule speaks of, and FREE."""
    out: dict[str, set[str]] = {section: set(keys.split()) for section, keys in FREE.items()}
    for keys in (REQUIRED, *REQUIRED_BY_METHOD.values(), REQUIRED_IF_THERE, UNITS, PATTERNS, NOT_PATTERNS, CHOICES):
        for section, names in keys.items():
            out.setdefault(section, set()).update(names)
    for section, key in EMAILS.items():
        out[section].add(key)
    for section in WITH_PROTOCOL:
        out[section] |= {f"{section}_PROTOCOL_{x}" for x in ("ID", "FILENAME", "COMMENTS")}
    return {section: sorted(keys) for section, keys in out.items()}


def known_sections() -> dict[str, list[str]]:
    """The sections that documents of each method may have."""
    return {m: [*REQUIRED, "SUBJECT_SAMPLE_FACTORS", *REQUIRED_BY_METHOD[m], *MAY_HAVE[m]] for m in (MS, NMR)}


def default_rules() -> list[tuple]:
    """The format's own rules. Every key that has no pattern and is no choice may not stand for a missing value."""
    out: list[tuple] = []
    add = lambda method, section, key, keyword, argument, message: out.append((method, section, key, keyword, argument, "Error", message))
    for method, sections in {ANY: REQUIRED, **REQUIRED_BY_METHOD}.items():
        for section, keys in sections.items():
            add(method, section, None, "required", None, None)
            for key in keys:
                add(method, section, key, "required", None, None)
    add(ANY, "SUBJECT_SAMPLE_FACTORS", None, "required", None, None)
    for section, keys in REQUIRED_IF_THERE.items():
        for key in keys:
            add(ANY, section, key, "required", None, None)
    for section, units in UNITS.items():
        for key, unit in units.items():
            number = f"({_RANGE}|{NUM})" if key in RANGES else NUM
            kind = "number or range" if key in RANGES else "number"
            add(ANY, section, key, "pattern", f"^{number} ({'|'.join(unit)})$", f" is no {kind} with a space and one of the units {', '.join(unit)}.{_MORE}")
    for section, patterns in PATTERNS.items():
        for key, pattern in patterns.items():
            said = " is no number without a unit." if key == "RECEIVER_GAIN" else " is no integer without a unit." if pattern == r"^\d+$" else f" does not match {pattern}"
            add(ANY, section, key, "pattern", pattern, said)
    for section, patterns in NOT_PATTERNS.items():
        for key, pattern in patterns.items():
            add(ANY, section, key, "not pattern", pattern, " is a polarity, which belongs in ION_MODE.")
    for section, choices in CHOICES.items():
        for key, choice in choices.items():
            add(ANY, section, key, "enum", "|".join(choice), f" is not one of {', '.join(choice)}.")
    for section, key in EMAILS.items():
        add(ANY, section, key, "format", EMAIL, " is not a valid email.")
    for section, keys in known_keys().items():
        add(ANY, section, None, "additionalProperties", "|".join(keys), None)
    for method, sections in known_sections().items():
        add(method, None, None, "additionalProperties", "|".join(sections), None)
    return out


def from_json_schema(schema: dict, method: str = ANY) -> list[tuple]:
    """The rules of a JSON Schema of a document, whose properties are sections and theirs are keys.

    Read are required, additionalProperties (false), minProperties, pattern, enum, minLength, maxLength, minimum, maximum,
    format (email) and not with an enum or pattern, and a `<keyword>_custom_message` beside a keyword; others are left out.
    """
    out: list[tuple] = [(method, section, None, "required", None, "Error", None) for section in schema.get("required", ())]
    if schema.get("additionalProperties") is False and schema.get("properties"):
        out.append((method, None, None, "additionalProperties", "|".join(schema["properties"]), "Error", None))
    for section, body in schema.get("properties", {}).items():
        out += [(method, section, key, "required", None, "Error", None) for key in body.get("required", ())]
        if body.get("additionalProperties") is False and body.get("properties"):
            out.append((method, section, None, "additionalProperties", "|".join(body["properties"]), "Error", None))
        if "minProperties" in body:
            out.append((method, section, None, "minProperties", str(body["minProperties"]), "Error", None))
        for key, rule in body.get("properties", {}).items():
            say = lambda keyword, default, rule=rule: rule.get(f"{keyword}_custom_message", default)
            if "pattern" in rule:
                out.append((method, section, key, "pattern", rule["pattern"], "Error", say("pattern", f" does not match {rule['pattern']}")))
            if "enum" in rule:
                out.append((method, section, key, "enum", "|".join(rule["enum"]), "Error", say("enum", " is not one of " + ", ".join(rule["enum"]) + ".")))
            for word, told in (("minLength", " is too short."), ("maxLength", " is too long."), ("minimum", " is too small."), ("maximum", " is too large.")):
                if word in rule:
                    out.append((method, section, key, word, str(rule[word]), rule.get(f"{word}_prefix", "Error").rstrip(": "), say(word, told)))
            if rule.get("format") == "email":
                out.append((method, section, key, "format", EMAIL, "Error", " is not a valid email."))
            for no in rule.get("not", {}).get("oneOf", [rule["not"]] if "not" in rule else []):
                if "enum" in no:
                    out.append((method, section, key, "not", "|".join(no["enum"]), "Error", None))
                if "pattern" in no:
                    out.append((method, section, key, "not pattern", no["pattern"], "Error", no.get("pattern_custom_message", f" matches {no['pattern']}")))
    return out


def broken(keyword: Column, argument: Column, value: Column) -> Column:
    """Whether a value breaks a rule; null counts as empty. A value that is no number breaks a bound."""
    value = F.coalesce(value, F.lit(""))
    size, bound, number = F.length(value), argument.try_cast("double"), value.try_cast("double")
    return (
        F.when(keyword.isin("pattern", "format"), ~F.rlike(value, argument))
        .when(keyword == "not pattern", F.rlike(value, argument))
        .when(keyword == "enum", ~F.array_contains(F.split(argument, r"\|"), value))
        .when(keyword == "not", F.array_contains(F.split(argument, r"\|"), value))
        .when(keyword == "minLength", size < bound)
        .when(keyword == "maxLength", size > bound)
        .when(keyword == "minimum", F.coalesce(number < bound, F.lit(True)))
        .when(keyword == "maximum", F.coalesce(number > bound, F.lit(True)))
        .otherwise(False)
    )


def broken_rules(items: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """items joined with the rules(on, keyword, argument, ...) that their value breaks; the table of rules is small."""
    return items.join(F.broadcast(table), on).filter(broken(F.col("keyword"), F.col("argument"), F.col("value")))


def lacking(owners: DataFrame, items: DataFrame, wanted: DataFrame, owner: str, on: list[str]) -> DataFrame:
    """owners with the wanted(on) keys that they have no item of; owners share some columns of on, or none."""
    shared = [c for c in on if c in owners.columns]
    each = owners.join(F.broadcast(wanted), shared) if shared else owners.crossJoin(F.broadcast(wanted))
    return each.join(items.select(owner, *on).distinct(), [owner, *on], "left_anti")


def _methods(t: Tables) -> DataFrame:
    """file_id and method of readable documents: NMR with an NM section, else MS."""
    nmr = t.items.filter("section = 'NM'").select("file_id").unionByName(t.results.filter("section = 'NM'").select("file_id")).distinct().withColumn("method", F.lit(NMR))
    return t.files.filter("error IS NULL").select("file_id", "data_section").join(nmr, "file_id", "left").withColumn("method", F.coalesce("method", F.lit(MS)))


def _issue(rows: DataFrame, keyword: str, section: Column, key: Column, severity: Column, message: Column) -> DataFrame:
    return rows.select(
        "file_id", F.lit(24).alias("id"), F.lit(f"JSON Schema Error: {keyword}").alias("name"), severity.alias("severity"), F.array(F.lit(TAGS[keyword])).alias("tags"),
        section.alias("section"), key.alias("sub_section"), F.concat(severity, F.lit(": "), message).alias("message"),
    )


def schema_issues(t: Tables, rules: list[tuple] | None = None, more: list[tuple] | None = None) -> DataFrame:
    """Rows of the issues table for every rule that a document breaks; rules: default_rules() where none are given; more: rules
    beside them, such as the known keys of sections (additionalProperties) by from_json_schema()."""
    spark: SparkSession = t.files.sparkSession
    given = rules is not None
    held = (rules if given else default_rules()) + (more or [])
    table = F.broadcast(spark.createDataFrame(held, RULE))
    methods = _methods(t)
    error, section, key = F.lit("Error"), F.col("section"), F.col("key")
    results = t.results.select("file_id", "section", F.concat(F.when(section == "NM", "NMR").otherwise(section), F.lit("_RESULTS_FILE")).alias("key"), F.col("filename").alias("value"))
    items = t.items.select("file_id", "section", "key", "value").unionByName(results).join(methods.select("file_id", "method"), "file_id")
    fits = lambda rows, m: (F.col(m) == ANY) | (F.col(m) == rows)
    where = F.concat(F.lit('["'), section, F.lit('"]["'), key, F.lit('"]'))

    # values
    one = table.filter("key IS NOT NULL AND keyword <> 'required'").withColumnRenamed("method", "of")
    value, keyword = F.coalesce("value", F.lit("")), F.col("keyword")
    bad = broken_rules(items, one, ["section", "key"]).filter(fits(F.col("method"), "of"))
    shown = F.when(F.length(value) < 50, F.concat(F.lit('The value, "'), value, F.lit('", in '), where)).otherwise(F.concat(F.lit("The value in "), where))
    out = None
    for name, words in (("pattern", ("pattern", "not pattern")), *((w, (w,)) for w in ("format", "enum", "minLength", "maxLength", "minimum", "maximum"))):
        part = _issue(bad.filter(keyword.isin(*words)), name, section, key, F.col("severity"), F.concat(shown, F.coalesce("message", F.lit(""))))
        out = part if out is None else out.unionByName(part)
    empty = F.concat(F.lit("A missing value stands in "), where, F.lit("."))
    out = out.unionByName(_issue(bad.filter("keyword = 'not'"), "not", section, key, F.col("severity"), empty))
    if not given:  # in the format's own rules, that holds for all keys without a pattern or choice, and for TAXONOMY_ID
        known = items.filter(missing(F.col("value"), SCHEMA_NA) & ~(key == "filename"))
        ruled = F.broadcast(spark.createDataFrame([r for r in held if r[2] and r[2] != "TAXONOMY_ID" and r[3] in ("pattern", "enum", "format")], RULE).select("section", "key").distinct())
        out = out.unionByName(_issue(known.join(ruled, ["section", "key"], "left_anti"), "not", section, key, error, empty))

    # keys and sections that should be there, or should not
    present = items.select("file_id", "section", "method").unionByName(t.ssf.select("file_id", F.lit("SUBJECT_SAMPLE_FACTORS").alias("section")).join(methods.select("file_id", "method"), "file_id")).distinct()
    wanted = table.filter("keyword = 'required' AND key IS NOT NULL").select(F.col("method").alias("of"), "section", "key")
    absent = lacking(present, items, wanted, "file_id", ["section", "key"]).filter(fits(F.col("method"), "of"))
    needed = F.concat(F.lit('The key "'), key, F.lit('" is needed in ["'), section, F.lit('"] and is not there.'))
    out = out.unionByName(_issue(absent, "required", section, key, error, needed))
    names: dict[str, list[str]] = {ANY: [], MS: [], NMR: []}
    for method, name, k, word, *_ in held:
        if word == "required" and k is None:
            names[method].append(name)
    all_of = {m: F.array(*map(F.lit, [*names[ANY], *names[m]])).cast("array<string>") for m in (MS, NMR)}
    each = methods.select("file_id", F.explode(F.when(F.col("method") == NMR, all_of[NMR]).otherwise(all_of[MS])).alias("section"))
    absent = each.join(present.select("file_id", "section"), ["file_id", "section"], "left_anti")
    out = out.unionByName(_issue(absent, "required", section, F.lit(""), error, F.concat(F.lit('The section "'), section, F.lit('" is needed and is not there.'))))
    closed = table.filter("keyword = 'additionalProperties' AND section IS NOT NULL").select(F.col("method").alias("of"), "section", F.split("argument", r"\|").alias("may"))
    more = items.join(closed, "section").filter(fits(F.col("method"), "of")).filter(~F.array_contains("may", key))
    out = out.unionByName(_issue(more, "additionalProperties", section, key, error, F.concat(F.lit('The key "'), key, F.lit('" is not known in ["'), section, F.lit('"].'))))
    may = table.filter("keyword = 'additionalProperties' AND section IS NULL").select(F.col("method").alias("of"), F.split("argument", r"\|").alias("may"))
    may = F.broadcast(may.groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("may"))).alias("may")))  # a rule or two for each method
    with_tables = present.unionByName(t.blocks.select("file_id", "section").distinct().join(methods.select("file_id", "method"), "file_id")).filter("section IS NOT NULL").distinct()
    odd = with_tables.join(may, (F.col("of") == ANY) | (F.col("of") == F.col("method"))).filter(~F.array_contains("may", section))
    out = out.unionByName(_issue(odd.select("file_id", "section").distinct(), "additionalProperties", section, F.lit(""), error, F.concat(F.lit('The section "'), section, F.lit('" is not known.'))))
    least = table.filter("keyword = 'minProperties'").select(F.col("method").alias("of"), "section", F.col("argument").cast("int").alias("least"))
    kinds = present.join(items.groupBy("file_id", "section").agg(F.countDistinct("key").alias("n")), ["file_id", "section"], "left")
    scarce = kinds.join(least, "section").filter(fits(F.col("method"), "of") & (F.coalesce("n", F.lit(0)) < F.col("least")))
    out = out.unionByName(_issue(scarce, "minProperties", section, F.lit(""), error, F.concat(F.lit('["'), section, F.lit('"] has too few keys.'))))
    if given:
        return out

    # a document has data or names a file of results
    no_data = methods.filter("data_section IS NULL").join(t.results.select("file_id"), "file_id", "left_anti")
    has = items.filter("section IN ('MS', 'NM')").select("file_id").distinct()
    own = F.when(F.col("method") == NMR, "NM").otherwise("MS")
    told = F.lit("There must be either a section of data or a file of results. Neither was found.")
    out = out.unionByName(_issue(no_data.join(has, "file_id", "left_semi"), "required", own, F.lit(""), error, told))
    # files of results
    parts = F.explode(F.map_from_arrays(F.array(*map(F.lit, ("filename", "UNITS", "Has m/z", "Has RT", "RT units"))), F.array("filename", "units", "has_mz", "has_rt", "rt_units")))
    told = t.results.select("file_id", "section", parts.alias("part", "value")).select("file_id", "section", F.concat(F.when(section == "NM", "NMR").otherwise(section), F.lit("_RESULTS_FILE")).alias("key"), "part", "value")
    place = F.concat(F.lit('["'), section, F.lit('"]["'), key, F.lit('"]'))
    unnamed = told.filter("part IN ('filename', 'UNITS') AND value IS NULL")
    out = out.unionByName(_issue(unnamed, "required", section, key, error, F.concat(F.lit('"'), "part", F.lit('" is needed in '), place, F.lit(" and is not there."))))
    void = told.filter("part <> 'filename' AND value IS NOT NULL").filter(missing(F.col("value"), SCHEMA_NA))
    out = out.unionByName(_issue(void, "not", section, key, error, F.concat(F.lit("A missing value stands in "), place, F.lit(" for "), "part", F.lit("."))))
    # samples
    sample = F.concat(F.lit("row "), F.col("idx") + 1)
    at = F.lit("SUBJECT_SAMPLE_FACTORS")
    out = out.unionByName(_issue(t.ssf.filter(missing(F.col("sample_id"), SCHEMA_NA)), "not", at, sample, error, F.concat(F.lit("No sample ID stands in "), sample)))
    pairs = t.ssf.select("file_id", "idx", F.explode(F.concat("factors", "additional")).alias("p")).filter("p.value = ''")
    return out.unionByName(_issue(pairs, "minLength", at, sample, F.lit("Warning"), F.concat(F.lit('"'), "p.key", F.lit('" is missing a value in '), sample)))
