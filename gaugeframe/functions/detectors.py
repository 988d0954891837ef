"""What free text of records says: released or closed, by machines or people, how many GPUs, which names.

All are column expressions; a null text says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normal_text

# Patterns of statements, in Java's regular expressions.
SCORE_OUTPUT = r"(?i)\bscor(?:e|es|ed|ing)\b|\bmetrics?\b|\baccuracy\b|\bau(?:roc|prc|c)\b|\bf1\b|\bcorrelations?\b|\bspearman\b|\bperformance\b|\bresults?\b"
PLACEHOLDER = r"(?i)\bto be (?:supplied|provided|written|added|released|implemented)\b|\bstill being (?:organi[sz]ed|prepared|processed|curated|assembled|uploaded)\b|\bcannot be inferred\b|\bnot yet (?:released|available|public|provided)\b|\bcoming soon\b|\bTODO\b"
CPU_ONLY = r"(?i)\bno (?:accelerator|gpu)s? (?:is |are )?(?:required|needed)\b|\bcpu[- ]only\b|\bdoes not need a gpu\b"
RELEASED = r"(?i)github\.com|gitlab|huggingface\.co|hugging face|bioconda|bioconductor|pypi|docker|zenodo|\bapi\b|\b(?:public|open|released|downloadable|open-source)\b[^.;]*\b(?:code|weights|checkpoints?|software|package|source|models?)\b|\b(?:code|source code|software) at\b"
OTHER_CODE = r"(?i)\b(?:calibration|evaluation|analysis|benchmark(?:ing)?|scoring|plotting|comparison) (?:code|scripts?)\b[^;]*"
NO_RELEASE = r"(?i)\bno (?:public )?(?:code|model weights|weights)\b[^.;]*\b(?:code|weights)\b|\bnot (?:openly |publicly )?available\b|\bnot released as software\b|\bclosed system\b|\bno released (?:implementation|code|software)\b|\bno executable code\b"
LABORATORY = r"(?i)\blaboratory (?:tests?|workflow)\b|\b(?:commercial|clinical) assay\b"
BY_PEOPLE = r"(?i)\b(?:expert|manual|human)[- ](?:re-?)?(?:interpretation|analysis|reanalysis|review|curation|classification|annotation|reading)\b|\bby (?:laboratory |clinical |trained |human )?(?:experts?|clinicians?|curators?|pathologists?|geneticists?|annotators?)\b"
DATA_CLOSED = r"(?i)\bnot (?:openly |publicly |yet )?(?:public|available|released|shared|deposited|published|downloadable|openly downloadable)\b|\bcontrolled[- ]access\b|\bdbgap\b|\bdata access (?:committee|agreement)\b|\bon (?:reasonable )?request\b|\bproprietary\b|\baccess not established\b|\bauthenticated access\b|\bno (?:public )?(?:data|structure|design file)s? (?:is |are )?(?:released|public|available)\b"
DATA_OPEN = r"(?i)https?://|\bftp\b|\bdoi[: ]|\b10\.\d{4,}/|zenodo|figshare|dryad|synapse|\b(?:SRA|ENA|GEO|SRR|SRP|SRX|ERR|ERP|PRJNA|PRJEB|GSE|GSM)\d*\b|\bsupplementary (?:data|table|file|dataset)s?\b|\bpublic(?:ly)? (?:download|available|release)\b|\bopen access\b"
ABOUT_DATA = r"(?i)\b(?:data(?:sets?)?|reads?|sequenc\w*|samples?|genomes?|cohorts?|participants?|variants?|files?|bams?|fastqs?|lists?|truth(?: sets?)?)\b"
GPU = r"(?i)gpu|nvidia|a100|h100|v100|l4\b|l40|a10\b|t4\b|rtx|tesla"
GPU_COUNT = r"(?i)(\d+)\s*(?:[×x*]\s*)?(?:nvidia|tesla|quadro|geforce|a100|h100|v100|l40|l4|a10|t4|rtx|gpus?)"
NUMBER_WORDS = (
    r"(?i)\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|"
    r"hundreds?|thousands?|millions?|dozens?|half|halves|thirds|quarters?|twice|percent|per cent|zero)\b"
)
TWO_OF_THEM = r"(?i)\b(?:the|both|these|those) two (?:systems|models|methods|tools|sides|studies)\b|\btwo-study\b"
COMMON_WORDS = (
    "WGS WES WXS CNV CNVS SNV SNVS SNP SNPS INDEL INDELS SV SVS GIAB DNA RNA CDNA CFDNA CTDNA NGS PCR AUC AUROC AUPRC ROC MCC VCF BAM GRCH37 GRCH38 HG19 HG38 "
    "CLINVAR GNOMAD HGMD DBSNP ENCODE GTEX TCGA COSMIC ONCOKB OMIM HPO"
).split()
SIZE_OR_YEAR = r"^\d+(?i:bp|kb|mb|gb|x)$|^(?:19|20)\d\d$"
NEGATION = r"(?<!\b(?:no|not|without)\s{1,8})"
UNREPORTED = r"(?i)^(?:unreported|not stated|unknown|none)\b"


def says(text: Column, pattern: str) -> Column:
    """Whether a text holds a pattern; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def affirmed(text: Column, pattern: str) -> Column:
    """The first match that no "no", "not" or "without" stands right before; null without one."""
    flags, body = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return F.regexp_substr(text, F.lit(f"{flags}{NEGATION}(?:{body})"))


def tidy(text: Column) -> Column:
    """Comments out, mentions without their sign, long dashes as commas, short ones as hyphens, trimmed."""
    t = F.regexp_replace(text, r"<!--[\s\S]*?-->", "")
    t = F.regexp_replace(t, r"(^|[^\w`])@(?=[A-Za-z0-9])", "$1")
    return F.btrim(F.translate(F.regexp_replace(t, r"\s*—\s*", ", "), "–", "-"), F.lit(" \t\r\n"))


def sentences(text: Column) -> Column:
    """Sentences, clauses and lines of a text, without heading signs."""
    return F.transform(F.split(text, r"(?<=[.;])\s+|\n+"), lambda s: tidy(F.regexp_replace(s, r"^#+\s*", "")))


def sentence_with(text: Column, pattern: str, about: str | None = None, most: int = 240) -> Column:
    """The first sentence that holds the pattern (and ``about``, if given), cut to ``most`` characters; null without one."""
    first = F.get(F.filter(sentences(text), lambda s: s.rlike(pattern) & (s.rlike(about) if about else F.lit(True))), F.lit(0))
    return F.when(F.length(first) > most, F.concat(F.left(first, F.lit(most - 3)), F.lit("..."))).otherwise(first)


def released(access: Column) -> Column:
    """Whether an access statement names something to run: the code of an evaluation alone does not count, nor a statement that denies it."""
    return says(F.regexp_replace(access, OTHER_CODE, ""), RELEASED) & ~says(access, NO_RELEASE)


def runs_by(access: Column, description: Column, pinned: Column) -> Column:
    """``software``, ``closed``, ``laboratory``, ``people`` or ``unknown``, the first that holds; ``pinned`` says that something runnable is recorded."""
    return (
        F.when(F.coalesce(pinned, F.lit(False)) | released(access), "software")
        .when(says(access, NO_RELEASE), "closed")
        .when(affirmed(access, LABORATORY).isNotNull(), "laboratory")
        .when(affirmed(description, BY_PEOPLE).isNotNull(), "people")
        .otherwise("unknown")
    )


def data_access(access: Column, notes: Column) -> Column:
    """``closed``, ``open`` or ``unknown``: a closed statement wins; one in the notes must be about data."""
    closed = says(access, DATA_CLOSED) | sentence_with(notes, DATA_CLOSED, ABOUT_DATA).isNotNull()
    return F.when(closed, "closed").when(says(access, DATA_OPEN), "open").otherwise("unknown")


def readiness(outputs: Column, run_text: Column, known_protocol: Column) -> Column:
    """``ready``, ``no score``, ``unknown protocol`` or ``unfinished``: whether a recipe can be followed to a score."""
    scored = F.coalesce(F.exists(outputs, lambda o: o.rlike(SCORE_OUTPUT)), F.lit(False))
    return F.when(~scored, "no score").when(~F.coalesce(known_protocol, F.lit(True)), "unknown protocol").when(sentence_with(run_text, PLACEHOLDER).isNotNull(), "unfinished").otherwise("ready")


def gpu_count(hardware: Column) -> Column:
    """The number before a GPU's name; null if none is named or counted."""
    return F.when(says(hardware, GPU), F.regexp_extract(hardware, GPU_COUNT, 1).try_cast("int"))


def repository(url: Column) -> Column:
    """``owner/name`` in lower case of a GitHub URL; null for others."""
    part = r"(?i)github\.com/([^/\s]+)/([^/\s#?]+)"
    name = F.lower(F.concat(F.regexp_extract(url, part, 1), F.lit("/"), F.regexp_replace(F.regexp_extract(url, part, 2), r"\.git$", "")))
    return F.when(says(url, part), name)


def distinctive(name: Column) -> Column:
    """Words of three characters or more that have a digit or two capitals, once each."""
    words = F.split(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & (w.rlike("[0-9]") | w.rlike("[A-Z].*[A-Z]"))))


def is_common(word: Column) -> Column:
    """Words that many names share, and sizes and years."""
    return F.upper(word).isin(*COMMON_WORDS) | word.rlike(SIZE_OR_YEAR)


def holds_words(text: Column, words: Column) -> Column:
    """Whether a normalised text holds the words as whole ones, in order."""
    w = normal_text(words)
    return (F.length(w) >= 3) & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))


def name_score(text: Column, name: Column) -> Column:
    """How strongly a normalised text names something: 100 in full; else ten per specific word if two of them (or its only one) stand there, and one per common word."""
    words = distinctive(name)
    specific, common = F.filter(words, lambda w: ~is_common(w)), F.filter(words, is_common)
    hits = F.size(F.filter(specific, lambda w: holds_words(text, w)))
    enough = (F.size(specific) > 0) & (hits >= F.least(F.lit(2), F.size(specific)))
    return F.when(holds_words(text, name), 100).when(enough, 10 * hits + F.size(F.filter(common, lambda w: holds_words(text, w)))).otherwise(0)


def cites(text: Column, identifier: Column) -> Column:
    """Whether a text holds an identifier as a whole word, not as a part of a longer one."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_.-])\Q"), identifier, F.lit(r"\E(?![A-Za-z0-9_-])"))
    return F.coalesce((identifier != "") & F.regexp_like(text, quoted), F.lit(False))


def stray_numbers(text: Column, names: Column) -> Column:
    """Numbers and number words of a text, once each, outside the given names that hold a digit, their words, and phrases such as "the two systems".

    A name's word counts if it has a digit and a letter, or is a year, and only
    as a whole word.  Longer names and words go first.
    """

    def longest_first(items: Column) -> Column:
        return F.array_sort(items, lambda a, b: F.length(b) - F.length(a))

    numbered = F.filter(names, lambda n: n.rlike("[0-9]"))
    words = F.transform(F.flatten(F.transform(numbered, lambda n: F.split(n, r"[\s,;:()\[\]/]+"))), lambda w: F.regexp_replace(w, r"""^[.'"]+|[.'"]+$""", ""))
    words = F.array_distinct(F.filter(words, lambda w: (w.rlike("[0-9]") & w.rlike("[A-Za-z]")) | w.rlike(r"^(?:19|20)\d\d$")))
    rest = F.aggregate(longest_first(numbered), text, lambda t, n: F.replace(t, n, F.lit(" ")))
    rest = F.aggregate(longest_first(words), rest, lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w.-])\Q"), w, F.lit(r"\E(?![\w-])")), F.lit(" ")))
    rest = F.regexp_replace(rest, TWO_OF_THEM, " ")
    return F.array_distinct(F.concat(F.regexp_extract_all(rest, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), F.regexp_extract_all(rest, F.lit(NUMBER_WORDS), F.lit(0))))


def has_link(text: Column) -> Column:
    """Whether a text holds a link or an issue number."""
    return says(text, r"https?://|www\.|#\d")


def reported_values(raw: Column) -> Column:
    """Numbers of ``name|position:value|...|Warnings:...`` chunks that commas join; fields without a number are skipped."""
    fields = F.filter(F.split(raw, "[,|]"), lambda f: F.contains(f, F.lit(":")) & ~f.startswith("Warnings"))
    return F.array_compact(F.transform(fields, lambda f: F.trim(F.substr(f, F.instr(f, ":") + 1)).try_cast("double")))


def _largest(values: Column) -> Column:
    """An array of the largest value, if there are values and that is below infinity; else empty. NaN counts as the largest. Each value is computed once."""
    return F.filter(F.array(F.array_max(values)), lambda x: x < F.lit(float("inf")))


def largest_change(raw: Column) -> Column:
    """The largest absolute reported value; null if there is none or one is not finite."""
    return F.get(_largest(F.transform(reported_values(raw), lambda x: F.abs(x))), F.lit(0))


def best_delta(entries: Column, first: int = 2, count: int = 4) -> Column:
    """The largest of ``count`` fields from ``first`` on over ``a|b|...`` entries, 0 at least; null if any field is no finite number."""
    fields = F.transform(entries, lambda e: F.split(e, r"\|"))
    values = F.flatten(F.transform(fields, lambda f: F.array(*[F.get(f, F.lit(i)).try_cast("double") for i in range(first, first + count)])))
    finite_or_nan = F.transform(values, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(float("nan"))))
    return F.get(F.transform(_largest(finite_or_nan), lambda x: F.greatest(F.lit(0.0), x)), F.lit(0))


def joined_ends(spans: Column, field: str, shift: int = 0) -> Column:
    """One end of each span as text with a comma after every one."""
    return F.array_join(F.transform(spans, lambda s: F.concat((s[field] + shift).cast("string"), F.lit(","))), "")


def spans_of(starts: Column, stops: Column, shift: int = 0) -> Column:
    """Structs ``start, stop`` from two such texts."""

    def numbers(c: Column, by: int) -> Column:
        return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int") + by)

    return F.arrays_zip(numbers(starts, shift).alias("start"), numbers(stops, 0).alias("stop"))
