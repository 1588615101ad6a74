"""Intents, document kinds, folder names, and how errors are treated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import humanized, strip

#: Intent, collections, tone, priority, and patterns searched without regard to case (fixed values).
INTENTS = {
    "policy_inquiry": (["policy_docs", "plan_comparisons"], "informative, comprehensive", 2, [r"what (does|is) (this|the) plan cover", r"what('s| is) included", r"explain (the|this) policy", r"benefits? (of|in) (this|the) plan"]),
    "objection": (["plan_comparisons", "value_props", "competitor_notes"], "empathetic, persuasive, value-focused", 1, [r"too expensive", r"(better|cheaper) (option|plan|deal) (elsewhere|outside|online)", r"my (current|existing|old) plan (is|was) better", r"why (should|would) (i|we) (buy|take|choose) (this|your)"]),
    "premium_concern": (["premium_tables", "discount_rules", "tax_benefits"], "factual, number-specific, budget-aware", 2, [r"(how much|what is the) premium", r"(monthly|annual|yearly) (cost|payment)", r"(reduce|lower|decrease) (the|my) premium", r"(tax|80d|deduction|exemption)"]),
    "claim_question": (["claim_docs", "hospital_network", "tpa_process"], "process-oriented, step-by-step, reassuring", 2, [r"(how|when|where) (do|can) (i|we) (file|raise|submit) a claim", r"cashless (treatment|facility|claim)", r"(network|empanelled) hospital", r"(claim|insurance) (rejected|denied|declined)"]),
    "exclusion_concern": (["exclusion_lists", "policy_wordings", "faq_docs"], "honest, clear, offer alternatives", 2, [r"(what is|what's) not covered", r"exclusion(s)?", r"(dental|vision|cosmetic|plastic surgery)", r"(pre.?existing).{0,20}(not|never|won't)"]),
    "buying_signal": (["onboarding_docs", "document_checklist", "payment_process"], "action-oriented, fast, remove friction", 3, [r"(how|where|when) (do|can) (i|we) (buy|purchase|apply)", r"(let's|ready to) (proceed|go ahead|buy)", r"(what|which) documents? (do i need|required)", r"(payment|pay|upi|card) (link|option|method)"]),
}
#: An agent's instructions to change the last answer (fixed values).
REFINEMENTS = ("make it shorter", "rephrase", "add example", "add an example")
#: Which side a stream carries (fixed values).
STREAMS = {"mic": "agent", "system": "customer"}
#: Names under which an answer may come, in this order (fixed values).
ANSWER_FIELDS = ("answer", "response", "result", "text", "message", "output")


def intents_of(text: Column) -> Column:
    """Names of all intents with a pattern in the text, by falling priority and then in the table's order."""
    ranked = sorted(INTENTS, key=lambda name: -INTENTS[name][2])
    # the patterns are in small letters: matching lowered text is much faster than folding case in the pattern
    low = F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))
    hits = [F.when(low.rlike("|".join(f"(?:{p})" for p in INTENTS[name][3])), F.lit(name)) for name in ranked]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def is_refinement(speaker: Column, text: Column) -> Column:
    said = F.lower(text)
    return (speaker == "agent") & F.coalesce(F.greatest(*[F.contains(said, F.lit(p)) for p in REFINEMENTS]), F.lit(False))


def side_of_stream(stream: Column) -> Column:
    """The side of a stream; an unknown stream is an error."""
    known = F.when(stream == "mic", "agent").when(stream == "system", "customer")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown stream "), F.coalesce(stream, F.lit("null")))))


def folder_parts(folder: Column, prefix: str = "kml-") -> Column:
    """``(sub_category, plan_no, uin)`` of a folder name such as ``kml-amber-steps-plan-749-512L317V02``."""
    name = strip(folder)
    uin = F.upper(F.regexp_extract(name, r"-(\d{3}[A-Za-z]\d{3}[A-Za-z]\d{2})$", 1))
    rest = F.regexp_replace(name, r"-\d{3}[A-Za-z]\d{3}[A-Za-z]\d{2}$", "")
    plan = F.regexp_extract(rest, r"-(\d{3})$", 1)
    bare = F.regexp_replace(rest, r"-\d{3}$", "")
    # the words that announce a plan number go only where there was one
    label = F.regexp_replace(F.regexp_replace(bare, r"(?i)-plan-no$", ""), r"(?i)-plan$", "")
    own = F.regexp_replace(F.when(plan != "", label).otherwise(bare), f"(?i)^{prefix}", "")
    return F.struct(humanized(F.regexp_replace(own, "^-+|-+$", "")).alias("sub_category"), plan.alias("plan_no"), uin.alias("uin"))


#: Patterns that tell kinds of documents, and what ends a line (fixed values).
_BROCHURE = r"(?i)(?<![a-zA-Z0-9])(brochure|brouchure|leaflet)(?![a-zA-Z0-9])"
_SHEET = r"(?i)(?<![a-zA-Z0-9])cis(?![a-zA-Z0-9])|customer\s*information\s*sheet"
_POLICY = r"(?i)pol(?:icy)?[\s_]*doc(?:ument)?"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def title_of(meta_title: Column, first_page: Column) -> Column:
    """The stored title unless it is a stand-in, else the first line of five characters or more, else empty."""
    own = strip(F.coalesce(meta_title, F.lit("")))
    line = F.get(F.filter(F.transform(F.split(F.coalesce(first_page, F.lit("")), LINE_ENDS), strip), lambda x: F.length(x) >= 5), F.lit(0))
    return F.when((own != "") & ~F.lower(own).isin("untitled", "microsoft word"), own).otherwise(F.coalesce(line, F.lit("")))


def doc_type(filename: Column, title: Column, first_page: Column) -> Column:
    hay = F.concat_ws("\n", filename, title, F.substring(F.coalesce(first_page, F.lit("")), 1, 1000))
    return (
        F.when(filename.rlike(_BROCHURE) | hay.rlike(_BROCHURE), "Sales Brochure")
        .when(hay.rlike(_SHEET), "Customer Information Sheet")
        .when(hay.rlike(_POLICY), "Policy Document")
        .otherwise(F.when(title != "", title).otherwise("Other"))
    )


def error_action(code: Column) -> Column:
    return F.when(code.isin(401, 403), "fatal").otherwise("retry")


def retry_delays(attempts: Column, base: float = 1.0) -> Column:
    """Seconds before each retry: doubled each time."""
    return F.when(attempts > 1, F.transform(F.sequence(F.lit(1), attempts - 1), lambda n: F.lit(base) * F.pow(F.lit(2.0), n - 1))).otherwise(F.array().cast("array<double>"))


def answer_text(body: Column) -> Column:
    """The first of the known fields that holds a string, else the whole body."""
    parsed = F.try_parse_json(body)
    field = lambda name: F.try_variant_get(parsed, f"$.{name}", "variant")
    texts = [F.when(F.schema_of_variant(field(name)) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string")) for name in ANSWER_FIELDS]
    return F.coalesce(*texts, body)


def age_hours(stamp: Column, now: Column) -> Column:
    """Hours from an ISO text to ``now``; texts without a zone are UTC, as the session is. Null for what is no time."""
    return (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(stamp))) / 3.6e9


def recency(age_hours: Column) -> Column:
    """exp(-age/168); 1 where the age is unknown."""
    return F.coalesce(F.exp(-age_hours / 168.0), F.lit(1.0))


def final_score(similarity: Column, age_hours: Column) -> Column:
    return 0.7 * similarity + 0.3 * recency(age_hours)
