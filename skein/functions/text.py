"""Text expressions: tokens, languages, identifiers, embedding text, JSON found in prose. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and words that tell Turkish questions.
TURKISH_LETTERS = "ğüşıöçĞÜŞİÖÇ"
TURKISH_WORDS = ("nedir", "nasıl", "için", "ile", "bir", "olan", "hangi", "yapılır", "oluştur", "kullan", "ayarla", "konfigüre")
# Fields of a node that make its embedding text, in order.
NODE_TEXT_FIELDS = ("node_type", "node_id", "name", "description", "key_logic", "acceptance_criteria", "rationale", "summary")
# English terms of Turkish ones.
TERMS = {
    "saat": "clock CLK clk_wiz MMCM PLL",
    "bellek": "memory DDR BRAM RAM",
    "bellek haritası": "address map create_bd_addr_seg offset",
    "adres haritası": "address map create_bd_addr_seg SEG offset",
    "adres": "address baseaddr offset",
    "kesme": "interrupt irq INTC",
    "zamanlama": "timing constraint create_clock",
    "sentez": "synthesis synth_1 synth_design",
    "frekans": "frequency Hz MHz localparam",
    "yazılım": "software firmware C code",
    "çalışma modu": "operating mode DEMO_MODE",
    "buton": "button",
    "varsayılan": "default init",
    "çalıştırılabilir": "standalone AXI master",
    "ivmeölçer": "accelerometer ADXL362",
    "ivme": "accelerometer axis",
    "sıcaklık sensörü": "temperature sensor ADT7420 I2C",
    "sıcaklık": "temperature sensor",
    "mikrofon": "microphone PDM",
    "ses çıkışı": "audio output PWM amplifier",
    "ses": "audio tone PWM",
    "ekran": "display seven-segment digit",
    "yedi segment": "seven-segment display digit anode cathode",
    "7 segment": "seven-segment display digit anode cathode",
    "seri port": "serial UART baud rate",
    "ddr3": "DDR2 mig_7series MIG SDRAM",
}


def tokens(text: Column) -> Column:
    """Distinct tokens in order: lower-cased runs of letters, digits and underscores, each followed by the parts between its underscores."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1)
    parts = F.transform(words, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: p != ""))).otherwise(F.array(w)))
    return F.array_distinct(F.flatten(parts))


def is_turkish(text: Column) -> Column:
    """True where a text has a Turkish letter or one of its stop words."""
    words = F.split(F.lower(text), r"\s+")
    return text.rlike(f"[{TURKISH_LETTERS}]") | F.arrays_overlap(words, F.array(*map(F.lit, TURKISH_WORDS)))


def collection_name(text: Column) -> Column:
    """An identifier of 3 to 63 lower-case letters, digits and single underscores that begins with a letter: 'proj_' stands before a digit, '_project' after what is too short."""
    c = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    c = F.when(c.rlike("^[0-9]"), F.concat(F.lit("proj_"), c)).otherwise(c)
    return F.substring(F.when(F.length(c) < 3, F.concat(c, F.lit("_project"))).otherwise(c), 1, 63)


def project_id(text: Column) -> Column:
    """Lower-case letters, digits and single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(text: Column) -> Column:
    """Words joined by underscores, 40 characters at most."""
    return F.substring(project_id(text), 1, 40)


def node_text_of(nodes: DataFrame) -> Column:
    """The embedding text of nodes, of those of its fields that the table has; lists are joined by blanks."""
    kinds = dict(nodes.dtypes)
    return node_text(*((F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f)) for f in NODE_TEXT_FIELDS if f in kinds))


def flattened(df: DataFrame) -> DataFrame:
    """df with lists, maps and structs as JSON texts, and empty texts for null ones."""
    nested = [f for f, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({f: F.coalesce(F.to_json(f), F.lit("")) for f in nested}) if nested else df


def node_text(*fields: Column) -> Column:
    """The fields that have something, joined by blanks."""
    return F.concat_ws(" ", *(F.when(F.trim(f) != "", f) for f in fields))


def strip_comments(text: Column) -> Column:
    """JSON text without // and /* */ comments; a // after a colon, as in an address, stays."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(?<!:)//[^\n]*$", "")


def json_in_text(text: Column) -> Column:
    """The JSON object of an answer: the whole text, else a fenced block, else from the first to the last brace; null if none parses."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    tried = [F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c) for c in (text, fenced, braces)]
    return F.coalesce(*tried)


def category(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose text is in the path, whatever the case."""
    found = F.lit(default)
    for part, name in reversed(rules):
        found = F.when(F.contains(F.lower(path), F.lit(part.lower())), F.lit(name)).otherwise(found)
    return found


def augment(text: Column, terms: dict[str, str] = TERMS) -> Column:
    """The text, and after a bar the translations of all terms that it holds, in order of the terms; combining dots above are dropped before looking."""
    plain = F.regexp_replace(F.lower(text), "\u0307", "")
    extra = F.filter(F.array(*(F.when(F.contains(plain, F.lit(k)), F.lit(v)) for k, v in terms.items())), lambda x: x.isNotNull())
    return F.when(F.size(extra) > 0, F.concat(text, F.lit(" | "), F.array_join(extra, " "))).otherwise(text)


def translated(questions: DataFrame, translate) -> DataFrame:
    """questions (question_id, question) with Turkish ones put through a translator, a function of a list of texts that runs on the driver before any plan; what it fails on stays as it is."""
    rows = questions.where(is_turkish(F.col("question"))).select("question_id", "question").collect()
    try:
        out = list(translate([r.question for r in rows])) if rows else []
    except Exception:
        out = []
    if len(out) != len(rows) or not rows:
        return questions
    t = questions.sparkSession.createDataFrame([(r.question_id, x or r.question) for r, x in zip(rows, out, strict=True)], f"question_id {questions.schema['question_id'].dataType.simpleString()}, _t string")
    return questions.join(t, "question_id", "left").withColumn("question", F.coalesce("_t", "question")).drop("_t")
