"""What a reader is told: things to do, plain words, table cells and marked places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which categories ask for which kind of advice.
ADVICE_FOR = {
    "sale": ["Sale/Share", "Data Sale / Sharing"], "rights": ["User Rights", "Data Rights", "Individual Rights", "Privacy Rights"], "training": ["AI Training", "AI Training Opt-Out"],
    "automation": ["Automated Decision-Making", "ADM", "Consequential AI Decisions"], "children": ["Children's Privacy", "COPPA Compliance", "Minors"],
}
# Default wordings, a parameter of action_items(): for all, for each context, by kind.
ADVICE = {
    "all": ["See which rights and ways out the clauses above name."],
    "contexts": {
        "want_understand": ["Write down the clauses that surprised you and decide whether they are acceptable."],
        "for_child": ["Set up a family account before a child signs in.", "Turn off face and voice recognition where possible.", "Ask to be told when the terms change."],
        "for_care": ["Go through the settings together with the person you help.", "Check who else may get into the account."],
        "for_work": ["Have a lawyer read the liability and change clauses.", "Compare with the data processing agreement."],
        "just_curious": ["Keep the unusual clauses in mind."],
    },
    "sale_ca": "Use the Californian right to refuse sale and sharing of data.", "sale": "Look for a setting against sale and sharing of data.",
    "rights_eu": "Ask for a copy, correction or erasure under European law; authorities hear complaints.", "rights": "Account settings often offer a download and an erasure of data.",
    "training": "See whether content can be kept out of model training.", "automation": "Ask for a person to look at automated decisions.", "children": "Use parental controls, and report accounts of young children.",
}


def action_items(findings: DataFrame, docs: DataFrame, wording: dict = ADVICE, most: int = 5) -> DataFrame:
    """doc_id, action_items of docs(doc_id, codes, context): at most five, none for a document without findings.

    For all, then for each context in the given order, then by what was found; repeated lines once.
    """
    flags = findings.groupBy("doc_id").agg(*[F.bool_or(F.col("category").isin(c)).alias(k) for k, c in ADVICE_FOR.items()])
    d = docs.select("doc_id", "codes", "context").join(flags, "doc_id", "left")
    told = advice_lines({k: F.col(k) for k in ADVICE_FOR}, F.col("codes"), F.col("context"), wording, most)
    return d.select("doc_id", F.when(F.col("sale").isNull(), F.array().cast("array<string>")).otherwise(told).alias("action_items"))


def advice_lines(found: dict[str, Column], codes: Column, context: Column, wording: dict = ADVICE, most: int = 5) -> Column:
    """The lines for a document: found says for each kind of ADVICE_FOR whether a finding asks for it."""
    has = lambda c: F.coalesce(F.array_contains(codes, c), F.lit(False))
    europe = has("GDPR") | has("UK-GDPR")
    lines = [F.lit(x) for x in wording["all"]]
    for c, own in wording["contexts"].items():
        lines += [F.when(F.array_contains(context, c), x) for x in own]
    lines += [F.when(found["sale"] & has("US-CA"), wording["sale_ca"]).when(found["sale"], wording["sale"]), F.when(found["rights"] & europe, wording["rights_eu"])]
    lines += [F.when(found[k], wording[k]) for k in ("rights", "training", "automation", "children")]
    return F.slice(F.array_distinct(F.filter(F.array(*lines), lambda x: x.isNotNull())), 1, most)


# Parts of category names, and what to do about such a finding; severe ones come first, and something is always said.
SUGGESTIONS = [
    (["data sale", "third party", "sharing"], ["Object to the sale or sharing in writing.", "Complain to the authority if nothing happens."]),
    (["consent", "agreement"], ["Ask for a short list of what you consent to."]),
    (["retention", "deletion"], ["Ask for erasure.", "Take a copy of your data first."]),
    (["children", "minor"], ["Report data of children to the authority."]),
    (["health", "hipaa"], ["Complain to the health authority about misuse of records."]),
    (["arbitration", "class action"], ["Opt out of arbitration in time.", "See a lawyer before you agree."]),
]
SEVERE = ["Ask for an explanation of the clause before you accept.", "Look up earlier cases against the organisation."]
OTHERWISE = ["Ask for an explanation of the clause in writing.", "Compare with clearer terms elsewhere."]


def action_suggestions(category: Column, severity: Column) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    some = lambda lines, when: F.when(when, F.array(*map(F.lit, lines))).otherwise(F.array().cast("array<string>"))
    told = F.concat(some(SEVERE, F.lower(F.coalesce(severity, F.lit(""))).isin("critical", "high")), *[some(lines, F.greatest(*[low.contains(p) for p in parts], F.lit(False))) for parts, lines in SUGGESTIONS])
    return F.when(F.size(told) > 0, told).otherwise(F.array(*map(F.lit, OTHERWISE)))


#: Long words and what they mean to a child, replaced in this order.
PLAIN_WORDS = {
    "personal information": "facts about you", "personal data": "facts about you", "third parties": "other companies", "third party": "another company", "retention period": "how long they keep it", "retain": "keep",
    "collect": "gather", "consent": "saying yes", "biometric": "face, voice or finger", "automated decision": "choice made by a computer", "profiling": "guessing what you like", "terminate": "end", "liable": "to blame",
    "liability": "blame", "arbitration": "a private judge", "disclose": "tell", "pursuant to": "under", "jurisdiction": "place with its own laws", "minors": "children",
}


def simplify_explanation(text: Column, contexts: Column, words: dict[str, str] = PLAIN_WORDS) -> Column:
    """For a child: one kind of apostrophe, markup escaped, long words replaced; as it is for others."""
    out = F.translate(text, "’‘ʼ", "'''")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for k, v in words.items():
        out = F.regexp_replace(out, rf"(?i)\b{k}\b", v)
    return F.when(F.array_contains(contexts, "for_child"), out).otherwise(text)


#: What codes are called.
CODE_NAMES = {
    "US-CA": "California", "US-CO": "Colorado", "US-CT": "Connecticut", "US-NY": "New York", "US-TX": "Texas", "US-VA": "Virginia", "US-IL": "Illinois", "US-FED": "United States", "GDPR": "European Union",
    "EU-AI-ACT": "European Union (AI)", "UK-GDPR": "United Kingdom", "PIPEDA": "Canada", "CA-QC": "Quebec", "LGPD": "Brazil", "APP": "Australia", "APPI": "Japan", "PIPA": "South Korea", "POPIA": "South Africa", "DPDP": "India",
}


def friendly_jurisdictions(codes: Column, names: dict[str, str] = CODE_NAMES) -> Column:
    """Names of codes, unknown ones as they are, each once."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), c)))


def findings_table(findings: DataFrame) -> DataFrame:
    """doc_id, ord, severity, category, confidence in percent, excerpt of 90 characters at most."""
    excerpt = F.coalesce("excerpt", F.lit(""))
    return findings.select(
        "doc_id", "ord", F.coalesce("severity", F.lit("Low")).alias("severity"), F.coalesce("category", F.lit("—")).alias("category"),
        F.format_string("%.0f%%", F.bround(F.coalesce("confidence", F.lit(0.0)) * 100, 0)).alias("confidence"), F.when(F.length(excerpt) > 90, F.concat(F.substring(excerpt, 1, 90), F.lit("…"))).otherwise(excerpt).alias("excerpt"),
    )


def highlight_spans(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, start, end (code points): where excerpts stand in the text, longer ones first, without overlaps.

    A document's distinct excerpts meet its text in one row, and a task picks row by row.
    """
    wanted = findings.filter("length(excerpt) > 0").groupBy("doc_id").agg(F.collect_set("excerpt").alias("excerpts"))

    def pick(frames):
        for f in frames:
            rows = []
            for i, text, excerpts in zip(f["doc_id"], f["text"], f["excerpts"], strict=True):
                taken: list[tuple[int, int]] = []
                for x in sorted(excerpts, key=lambda x: (-len(x), x)):
                    at = text.find(x)
                    while at >= 0:
                        if all(at + len(x) <= a or b <= at for a, b in taken):
                            taken.append((at, at + len(x)))
                        at = text.find(x, at + len(x))
                rows += [(i, a, b) for a, b in sorted(taken)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end"])

    return docs.select("doc_id", "text").filter("text is not null").join(wanted, "doc_id").mapInPandas(pick, "doc_id long, start long, end long")

