"""Licence scans: sentence-rule recognition with DataFrame functions only.

A text is normalised: words in lower case, with a mark wherever a sentence may begin or end. Hard marks
(a full stop, an empty line) are always an end; soft ones (a single line break with any signs of
comments behind it, a tag, a colon or semicolon, the stop of a short form such as "Inc.") may also
stand inside a sentence. Known licence sentences
are found between marks, also behind a lead such as "this project is" and with a holder's name in
them, and the sequence of their identifiers is matched against ordered rules. A sentence that says
something else about a licence ("we use no code that is licensed under ...") is not a known one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.licence_texts import ANCHORS, GROUPS, SENTENCES

ENDS = r"[.!?;:]+(?=[\s]|$)|\n+"
HARD, SOFT = "\u0001", "\u0002"
#: Normalisation, step by step (pattern, replacement); each pattern reads alike in Java and RE2.
STEPS = [
    (r"</?[a-z][a-z0-9]*( [^<>\n]*)?/?>", "\n"),
    (r"[^a-z0-9\n.!?;:]+", " "),
    *((rf"\b{short}[.] *\n?", f"{short}\n") for short in ("v", "inc", "ltd", "corp", "co")),
    (r" *\n *\n[ \n]*", HARD),
    (r"[;:]*[.!?][.!?;:]*([ \n\x01]+|\z)", HARD),
    (r"[;:]+([ \n]+|\z)", SOFT),
    (r"\n", SOFT),
    (r"[.!?;:]+", " "),
    (r"[ \x02]*\x01[ \x01\x02]*", HARD + HARD),
    (r" *\x02[ \x02]*", SOFT + SOFT),
    (r" +", " "),
]
BETWEEN = r"(?: |\x02\x02)"
#: What may stand before a sentence that begins with one of the words, and how it is taken off again.
LEAD = rf"(?:(?:this|the|our){BETWEEN}(?:[a-z0-9]+{BETWEEN}){{1,3}}(?:is|are){BETWEEN})?"
LED, OFF = ("licensed", "released", "distributed"), r"^(this|the|our) ([a-z0-9]+ ){1,3}(is|are) "


def _pattern(sentences: dict[str, str]) -> str:
    """A known sentence (group 1) between marks, the longest of those that begin alike; each mark is doubled, so neighbours need not share one."""
    some = rf"[a-z0-9]+(?:{BETWEEN}[a-z0-9]+){{0,7}}"
    said = lambda s: (LEAD if s.startswith(LED) else "") + BETWEEN.join(some if w == "{}" else w for w in s.split())
    told = sorted(set(sentences.values()), key=lambda s: (-len(s), s))
    return r"[\x01\x02](" + "|".join(map(said, told)) + r")[\x01\x02]"


def _open(sentences: dict[str, str]) -> list[tuple[str, str]]:
    """(pattern, sentence) of the sentences with a variable part."""
    return [("^" + s.replace("{}", "[a-z0-9 ]+") + "$", s) for s in sorted(set(sentences.values())) if "{}" in s]


def _rule(identifiers: tuple[str, ...]) -> str:
    return "," + "(?:[^,]+,)*".join(f"{i}," for i in identifiers).replace(".", "[.]")


def normalised(text: Column) -> Column:
    """The text's words between marks, with a mark at either end."""
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit(HARD), F.trim(out), F.lit(HARD))


def scan(documents: DataFrame, doc: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None, groups: list | None = None) -> DataFrame:
    """One row per row of documents: doc_id, n_sentences, n_known, sentence_ids, licenses, spans.

    n_sentences counts pieces with a letter or digit between line breaks and ends of clauses;
    sentence_ids are the identifiers of the known sentences in text order, the longest where several
    begin alike; licenses the licence of each group of rules of which one is met, in the order of the
    groups; spans the first word (counted in the normalised text), the number of words and the
    identifier. Null and empty texts have no sentence and no licence; repeated rows keep a row each;
    texts may be of any length; the known sentences are a fixed table, so they stand in the plan;
    other columns are not read.
    """
    sentences, groups = sentences or SENTENCES, groups or GROUPS
    pattern = _pattern(sentences)
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = F.filter(F.split(whole, ENDS, -1), lambda x: x.rlike("[A-Za-z0-9]"))
    can = F.lower(whole).rlike("|".join(ANCHORS)) if sentences is SENTENCES else F.lit(True)
    names = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    base = documents.select(F.col(doc).alias("doc_id"), F.size(cut).cast("long").alias("n_sentences"), F.when(can, normalised(whole)).alias("norm"))

    words = lambda x: F.size(F.filter(F.split(x, r"[ \x01\x02]+"), lambda w: w != ""))
    said = F.regexp_extract_all("norm", F.lit(pattern), F.lit(1))
    base = base.withColumn("said", F.when(F.col("norm").isNotNull(), said).otherwise(F.array().cast("array<string>"))).withColumn("gaps", F.when(F.size("said") > 0, F.transform(F.split("norm", pattern, -1), words)))
    sizes = F.transform("said", words)
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    plain = lambda x: reduce(lambda y, o: F.regexp_replace(y, *o), _open(sentences), F.regexp_replace(x, r"\x02\x02", " "))
    known = lambda s: F.coalesce(F.try_element_at(names, s), F.try_element_at(names, F.regexp_replace(s, OFF, "")))
    span = lambda x, i: F.struct((total(F.col("gaps"), i + 1) + total(sizes, i)).alias("word"), words(x).alias("n"), known(plain(x)).alias("id"))
    got = base.select("doc_id", "n_sentences", F.transform("said", span).alias("spans"))
    got = got.withColumn("sentence_ids", F.array_join(F.transform("spans", lambda x: x["id"]), ","))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    met = [F.coalesce(*[F.when(line.rlike(_rule(r)), F.lit(n)) for n, r in group]) for group in groups]
    licences = F.when(F.size("spans") > 0, F.array_join(F.array_compact(F.array(*met)), ",")).otherwise("")
    return got.select("doc_id", "n_sentences", F.size("spans").cast("long").alias("n_known"), "sentence_ids", licences.alias("licenses"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    """op4 over all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _oracle() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    norm = "lower(coalesce(text, ''))"
    for pattern, by in STEPS:
        said = " || ".join("' '" if c == " " else f"chr({ord(c)})" for c in by)
        norm = f"regexp_replace({norm}, '{pattern}', {said}, 'g')"
    plain = "replace(raw, chr(2) || chr(2), ' ')"
    for pattern, by in _open(SENTENCES):
        plain = f"regexp_replace({plain}, '{pattern}', '{by}')"
    met = ", ".join("CASE " + " ".join(f"WHEN regexp_matches(l, '{_rule(r)}') THEN '{n}'" for n, r in group) + " END" for group in GROUPS)
    return rf"""
WITH known(id, s) AS (VALUES {known}),
d AS (SELECT row_number() OVER () r, doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?;:]+(\s|$)|\n+'), lambda x: regexp_matches(x, '[A-Za-z0-9]'))) n,
      regexp_extract_all(chr(1) || trim({norm}) || chr(1), '{_pattern(SENTENCES)}', 1) said FROM documents),
e AS (SELECT r, unnest(said) raw, generate_subscripts(said, 1) pos FROM d),
h AS (SELECT r, count(*) k, string_agg(id, ',' ORDER BY pos) ids FROM (SELECT r, pos, coalesce(a.id, b.id) id FROM (SELECT r, pos, {plain} s FROM e) x LEFT JOIN known a ON a.s = x.s LEFT JOIN known b ON b.s = regexp_replace(x.s, '{OFF}', '')) GROUP BY r),
j AS (SELECT doc_id, n, coalesce(k, 0) k, coalesce(ids, '') sentence_ids, ',' || coalesce(ids, '') || ',' l FROM d LEFT JOIN h USING (r))
SELECT doc_id, CAST(n AS BIGINT) n_sentences, CAST(k AS BIGINT) n_known, sentence_ids, array_to_string(list_filter([{met}], lambda x: x IS NOT NULL), ',') licenses FROM j
"""


ORACLE = _oracle()
