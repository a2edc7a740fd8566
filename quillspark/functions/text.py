"""Column functions over texts, identifiers and cues. All of them are built-in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Words whose start ends a glued surface; keywords of protein names; tokens that look like real identifiers.
GLUED_TAILS = "The This These Those Many Most And But However Although While Here There When Where Our We In Of To Is Are Was Were".split()
PROTEIN_WORDS = "receptor channel factor kinase transferase oxidase reductase synthase synthetase protease phosphatase transporter antigen ligand enzyme subunit complex hormone peptide antibody interleukin cytokine dehydrogenase polymerase hydrolase isomerase ligase".split()
# White space of all scripts, for use inside brackets.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
# End of fixed values.

def _when_chain(pairs, otherwise):
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def squeeze(text: Column) -> Column:
    """White space runs to one space, ends trimmed; Unicode white space counts."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def section_type(sec_type: Column, title: Column) -> Column:
    """A section's label: by its type attribute, else the first known word in its title, else body."""
    by_type = F.element_at(F.create_map(*(F.lit(x) for kv in rules.SECTION_TYPES.items() for x in kv)), F.lower(F.coalesce(sec_type, F.lit(""))))
    by_title = _when_chain([(F.contains(F.lower(title), F.lit(k)), F.lit(v)) for k, v in rules.SECTION_TITLES], F.lit("body"))
    return F.coalesce(by_type, by_title)


def local_id(identifier: Column) -> Column:
    """What follows the first colon; all of it where there is none."""
    return F.when(F.contains(identifier, F.lit(":")), F.regexp_replace(identifier, r"(?s)^[^:]*:", "")).otherwise(identifier)


def gate(db: Column, identifier: Column) -> Column:
    """struct(gate_pass, gate_reason) of an identifier, by the shape that its database's local ids have."""
    s = F.regexp_replace(local_id(identifier), r"^\s+|\s+$", "")

    def verdict(ok, reason):
        return F.struct(F.lit(ok).alias("gate_pass"), F.lit(reason).alias("gate_reason"))

    tests = [(identifier.isNull() | (s == ""), verdict(False, "empty")), (db.isin(*rules.EXCLUDED_FROM_GATE), verdict(False, "excluded")), (db.isNull() | ~db.isin(*[g[0] for g in rules.GATE]), verdict(True, "no-rule"))]
    good = {"soft": "soft-needs-downstream", "pass": "pass-structure", "hard": "pass"}
    for name, shape, kind, floor in rules.GATE:
        fits = s.rlike(rf"^(?:{shape})\z")
        tests += [((db == name) & fits, verdict(True, good[kind])), (db == name, verdict(False, f"floor<{floor}" if kind == "hard" else "structure"))]
    return _when_chain(tests, verdict(True, "no-rule"))


def clean_surface(surface: Column) -> Column:
    """struct(surface, left, right, rule): a surface without what a tokenizer glued to it, and the characters cut at each
    end. A doubled word comes first and alone; then one split of glued words; then punctuation at the end and the start."""
    n = F.length(surface)
    # \w and case of any script, as Python has them: a letter alone decides its lower case
    doubled = rf"^([\p{{L}}\p{{N}}_]+)[.{SPACE}]+([\p{{L}}\p{{N}}_]+)\n?\z"
    word, second = (F.regexp_extract(surface, doubled, k) for k in (1, 2))
    word = F.when(F.lower(F.translate(word, "Σİ", "σi")) == F.lower(F.translate(second, "Σİ", "σi")), word).otherwise("")
    digit = F.length(F.regexp_extract(surface, r"(?s)^(.*?\p{Nd})(?=[A-Z][a-z])", 1))
    head = F.regexp_extract(surface, r"(?s)^(.*?[a-z]{3})(?=[A-Z][a-z]{2})", 1)
    split = F.when(digit > 0, F.substring(surface, F.lit(1), digit)).when((head != "") & F.substr(surface, F.length(head) + 1).rlike("^(?:" + "|".join(GLUED_TAILS) + ")"), head).otherwise(surface)
    rule = F.when(digit > 0, "num_upper_split").when(F.length(split) < n, "lower_upper_split")
    tail = F.regexp_replace(split, r"[.,;:]+\z", "")
    both = F.regexp_replace(tail, r"^[.,;:\-]+", "")
    rule = F.coalesce(rule, F.when(F.length(tail) < F.length(split), "trailing_punct"), F.when(F.length(both) < F.length(tail), "leading_punct"), F.lit("none"))
    left = F.length(tail) - F.length(both)

    def result(s, a, z, r):
        return F.struct(s.alias("surface"), a.cast("int").alias("left"), z.cast("int").alias("right"), r.alias("rule"))

    same = result(surface, F.lit(0), F.lit(0), F.lit("none"))
    return (
        F.when(word != "", F.when(F.length(word) >= 2, result(word, F.lit(0), n - F.length(word), F.lit("dup_word"))).otherwise(same))
        .when((F.length(F.regexp_replace(both, rf"^[{SPACE}]+|[{SPACE}]+\z", "")) <= 1) | (both == surface), same)
        .otherwise(result(both, left, n - F.length(tail), rule))
    )


def link_id(raw: Column, entity_type: Column) -> Column:
    """A linker's id: what comes before a slash, with the prefix of genes and species."""
    s = F.trim(F.split_part(raw, F.lit("/"), F.lit(1)))
    return F.when((entity_type == "gene") & ~F.startswith(s, F.lit("NCBIGene:")), F.concat(F.lit("NCBIGene:"), s)).when((entity_type == "species") & ~F.startswith(s, F.lit("NCBITaxon:")), F.concat(F.lit("NCBITaxon:"), s)).otherwise(s)


def flat_table(s: Column) -> Column:
    """Whether a text is a table that lost its separators: 40 characters or more, few spaces, a long run without any."""
    spaces = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    run = F.array_max(F.transform(F.split(s, " "), lambda x: F.length(x)))
    return F.coalesce((F.length(s) >= 40) & (spaces < 0.06 * F.length(s)) & (run > 34), F.lit(False))


def signals(text: Column) -> dict[str, Column]:
    """The five role signals of a window's text, without the marks around its surface."""
    plain = F.coalesce(F.translate(text, "«»", ""), F.lit(""))
    return {k: plain.rlike("(?i)" + p) for k, p in rules.CUES.items()}


def route(cls: Column, dataset: Column, gen_dep: Column, use_acq: Column, avail: Column, ref_use: Column, das: Column, flat: Column) -> Column:
    """struct(role, prior, role_source, to_llm, note) of an entity, by an ordered ladder."""

    def to(role, prior, source, llm, note):
        return F.struct(F.lit(role).alias("role"), F.lit(prior).alias("prior"), F.lit(source).alias("role_source"), F.lit(llm).alias("to_llm"), (note if isinstance(note, Column) else F.lit(note)).alias("note"))

    ref, dep = cls.isin(*rules.REFERENCE_CLASSES), cls.isin(*rules.DEPOSIT_CLASSES)
    return _when_chain(
        [
            (cls == rules.OUT_OF_SCOPE, to("", "", "skip", False, "out_of_scope")),
            (ref & F.lower(dataset).isin(*rules.DOMAIN_FAMILIES), to("mentioned", "", "rule", False, "domain_family")),
            (ref & flat, to("mentioned", "", "rule", False, "flat_table")),
            (ref & ref_use, to("used", "", "rule", False, "ref_resource_use")),
            (ref & use_acq, to("", "use", "llm_pending", True, "ref_reuse_ambiguous")),
            (ref, to("", "none", "llm_pending", True, "default_to_llm")),
            (dep & use_acq & gen_dep, to("", "none", "llm_pending", True, "gen_use_conflict")),
            (dep & (gen_dep | (das & ~use_acq)), to("", "generated", "llm_pending", True, F.when(gen_dep, "gen_dep").otherwise("das_backed"))),
            (dep & use_acq, to("", "used", "llm_pending", True, "use_acq")),
            (dep & avail, to("", "none", "llm_pending", True, "avail_ambiguous")),
            (dep, to("", "none", "llm_pending", True, "no_cue")),
        ],
        to("", "none", "llm_pending", True, F.concat(F.lit("unknown_class:"), F.coalesce(cls, F.lit("")))),
    )


def year_of(citation: Column) -> Column:
    """struct(year, mode): the year after a sentence end, else any year word, else NA."""
    first, other = F.regexp_extract(citation, r"\.\s((?:19|20)\d{2})\b", 1), F.regexp_extract(citation, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(first != "", F.struct(first.alias("year"), F.lit("primary").alias("mode"))).when(other != "", F.struct(other.alias("year"), F.lit("fallback").alias("mode"))).otherwise(F.struct(F.lit("NA").alias("year"), F.lit(None).cast("string").alias("mode")))


def without_version(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, r"\.\d+$", ""), s)


def without_isoform(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, r"-\d+$", ""), s)


def in_capitals(s: Column) -> Column:
    return F.nullif(F.upper(s), s)


def doi_key(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"^https?://(dx\.)?doi\.org/", ""))


def accession_key(s: Column) -> Column:
    """Capitals, without a prefix up to a colon and without a version."""
    return F.split_part(F.upper(F.trim(local_id(s))), F.lit("."), F.lit(1))


def db_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def ontology_id(db: Column, s: Column, ontologies=("go", "hp", "mp", "doid", "cl", "clo", "uberon", "mondo", "efo", "sio", "nando", "ncit")) -> Column:
    """Colon to underscore where the database or the prefix is an ontology."""
    prefix = F.lower(F.split_part(s, F.lit(":"), F.lit(1)))
    return F.when(F.split_part(F.lower(db), F.lit("_"), F.lit(1)).isin(*ontologies) | (F.contains(s, F.lit(":")) & prefix.isin(*ontologies)), F.replace(s, F.lit(":"), F.lit("_"))).otherwise(s)


def length_bucket(n: Column) -> Column:
    return F.when(n <= 3, "01-03").when(n <= 6, "04-06").when(n <= 10, "07-10").when(n <= 20, "11-20").otherwise("21+")


def id_kind(identifier: Column) -> Column:
    """The id's source by its prefix; a null fits no prefix and comes after them."""
    return F.when(identifier.like("NCBIGene:%"), "gene").when(identifier.like("MESH:%"), "mesh").when(identifier.like("NCBITaxon:%"), "taxon").when(identifier.isNull(), "none").otherwise("other")


def is_noise(s: Column) -> Column:
    """One character or less, only digits and signs, or nothing of a-z and 0-9."""
    low = F.lower(F.trim(s))
    return (F.length(low) <= 1) | low.rlike(r"^[\d\W_]+$") | ~low.rlike("[a-z0-9]")


def safe_for_iri(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[A-Za-z0-9_.\-:]+\z"), F.lit(False))


def is_data_file(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(csv|tsv|txt|gz)$") & ~F.lower(name).rlike(r"(readme|license|changelog|md5|checksum)")


def estimated_tokens(s: Column) -> Column:
    return F.floor((F.length(s) + 3) / 4)


def gene_class(raw: Column, norm: Column) -> Column:
    """What a gene surface looks like, by an ordered ladder."""
    plain = F.trim(raw)
    return _when_chain(
        [
            (norm.rlike(r"\b(\w+)[.\s]+\1\b") | (F.contains(norm, F.lit(".")) & ~norm.rlike(r"\d\.\d")) | norm.rlike(r"^(background|the|and|with|of|in|by)\w{4,}"), F.lit("span_broken")),
            (F.startswith(raw, F.lit("-")) | F.endswith(raw, F.lit("-")) | (F.length(norm) <= 2), F.lit("fragment")),
            (norm.rlike("|".join(PROTEIN_WORDS)), F.lit("protein_like")),
            (plain.rlike(r"^[A-Z][A-Z0-9]{1,7}$") | plain.rlike(r"^[A-Z][A-Z0-9]{1,6}-[A-Za-z0-9]{1,6}$"), F.lit("gene_symbol")),
            (norm.rlike(r"(?:ase|ases)(?:\s|$)"), F.lit("protein_like")),
        ],
        F.lit("other"),
    )


def underscore_census(text: Column) -> Column:
    """struct(n, n_tokens, tokens): underscores, words with one inside, and the first ten of those."""
    found = F.regexp_extract_all(text, F.lit(r"(\w+_\w+)"), 1)
    return F.struct(F.regexp_count(text, F.lit("_")).alias("n"), F.size(found).alias("n_tokens"), F.slice(found, 1, 10).alias("tokens"))


def token_set(prefix: Column, dataset: Column, label: Column) -> Column:
    """Normalised names of a dataset: its prefix, whole and up to a dot, its id, whole and up to an underscore, its label."""
    names = F.array(prefix, F.split_part(prefix, F.lit("."), F.lit(1)), dataset, F.split_part(dataset, F.lit("_"), F.lit(1)), label)
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: db_key(F.coalesce(x, F.lit("")))), lambda x: x != "")))
