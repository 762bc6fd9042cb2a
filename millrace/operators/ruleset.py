"""The copy gate's policy as tables: rules with scope and parameters, terms, the claims register."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import copygate as c

RULE_SCHEMA = (
    "rule_no int, rule string, severity string, weight int, type string, channels array<string>, markets array<string>, "
    "params string, message string, fix string"
)
TERM_SCHEMA = "rule string, term string, evidence string"
REGISTER_SCHEMA = (
    "reg_no int, id string, claim string, numbers array<double>, qualifier string, markets array<string>, retired string, competitor string"
)

# Ids, severities, own weights, scopes, limits, terms, register. Messages are the house's own.
_ALL = None
_RULES = [
    ("LEN-RSA-HEAD", "block", None, "length", ["rsa"], _ALL, {"field": "headline", "max": 30}, "Headline: {len} characters of {max}.", "Cut it to {max}."),
    ("LEN-RSA-DESC", "block", None, "length", ["rsa"], _ALL, {"field": "description", "max": 90}, "Description: {len} characters of {max}.", "Cut it to {max}."),
    ("FMT-RSA-COUNT", "warn", None, "count", ["rsa"], _ALL, {"headline": 3, "description": 2}, "Only {have}.", "Add assets."),
    ("FMT-RSA-LABEL", "warn", 5, "unlabelled", ["rsa"], _ALL, {}, "{n} line(s) without a label.", "Label each line."),
    ("FMT-RSA-EXCLAIM", "block", None, "field-regex", ["rsa"], _ALL, {"field": "headline", "pattern": "!"}, "Exclamation mark in a headline.", "Remove it."),
    ("LEN-META-PRIMARY", "warn", None, "length", ["meta"], _ALL, {"field": "primary", "max": 125}, "Primary text: {len} characters of {max}.", "Say it in {max}."),
    ("LEN-META-HEAD", "warn", None, "length", ["meta"], _ALL, {"field": "headline", "max": 40}, "Headline: {len} characters of {max}.", "Cut it to {max}."),
    ("LEN-LI-MAX", "block", None, "length", ["linkedin"], _ALL, {"field": "body", "max": 3000}, "Post: {len} characters of {max}.", "Split it."),
    ("LEN-LI-HOOK", "warn", None, "hook", ["linkedin"], _ALL, {"max": 150}, "First line: {len} characters of {max}.", "Shorten the first line."),
    ("FMT-EMAIL-SUBJ", "warn", None, "required", ["email"], _ALL, {"field": "subject"}, "No subject.", "Add one."),
    ("LEN-EMAIL-SUBJ", "warn", None, "length", ["email"], _ALL, {"field": "subject", "max": 60}, "Subject: {len} characters of {max}.", "Cut it to {max}."),
    ("FMT-EMAIL-PRE", "info", None, "required", ["email"], _ALL, {"field": "preheader"}, "No preheader.", "Add one."),
    ("LEN-EMAIL-PRE", "warn", 5, "length", ["email"], _ALL, {"field": "preheader", "max": 110}, "Preheader: {len} characters of {max}.", "Cut it to {max}."),
    ("TOV-HYPE", "warn", 8, "phrase", _ALL, _ALL, {}, "Hype words: {terms}.", "Say what the product does."),
    ("TOV-PUSHY", "warn", 8, "phrase", _ALL, _ALL, {}, "Pressure: {terms}.", "Give a reason to act."),
    ("TOV-CUSTOM", "warn", 8, "phrase", _ALL, _ALL, {}, "Banned words: {terms}.", "Remove or rephrase."),
    ("TOV-EXCLAIM", "warn", 6, "exclaim", _ALL, _ALL, {"max": 1}, "{n} exclamation marks of {max}.", "Keep {max} at most."),
    ("TOV-CAPS", "warn", 6, "caps", _ALL, _ALL, {}, "In capitals: {terms}.", "Use sentence case."),
    ("TOV-EMOJI", "warn", 6, "regex", _ALL, _ALL, {"pattern": c.EMOJI}, "Emoji.", "Remove them."),
    ("TOV-LONG-SENT", "warn", 6, "sentence-length", _ALL, _ALL, {"max": 25}, "{n} sentence(s) of over {max} words.", "Split them."),
    ("TOV-PASSIVE", "info", None, "regex", _ALL, _ALL, {"pattern": c.PASSIVE}, "Perhaps passive: {terms}.", "Name who acts."),
    ("TOV-READABILITY", "warn", 8, "flesch", _ALL, _ALL, {"min": 50, "minWords": 30}, "Reading ease {score}, {min} wanted.", "Use shorter words."),
    ("TOV-PERSON", "warn", 6, "person", _ALL, _ALL, {"minPronouns": 3}, "We {we} times, you {you} times.", "Write to the reader."),
    ("CLM-OK", "info", None, "claim-outcome", _ALL, _ALL, {}, "Matches {ev}: {claim}.", "Keep the evidence with it."),
    ("CLM-UNSUB", "block", None, "claim-outcome", _ALL, _ALL, {}, "Nothing in the register for: {snippet}", "File evidence."),
    ("CLM-ALTERED", "block", None, "claim-outcome", _ALL, _ALL, {}, "Close to {ev} ({claim}), but says {got} for {want}.", "Use {want}."),
    ("CLM-QUALIFIER", "warn", 12, "claim-outcome", _ALL, _ALL, {}, "{ev} holds only with: {q}.", "Put it back: {claim}."),
    ("CLM-RETIRED", "block", None, "claim-outcome", _ALL, _ALL, {}, "{ev} is retired: {why}.", "Use the current claim."),
    ("CLM-MARKET", "block", None, "claim-outcome", _ALL, _ALL, {}, "{ev} is for {markets}, not {market}.", "Drop it here."),
    ("CLM-SUPERLATIVE", "block", None, "superlative", _ALL, _ALL, {}, "Superlative without evidence: {term}.", "File evidence first."),
    ("CMP-MENTION", "warn", 15, "competitor", _ALL, _ALL, {}, "Names a competitor: {terms}.", "Remove the name."),
    ("CMP-COMPARE", "block", None, "comparative", _ALL, _ALL, {}, "Compares with {comp}: {term}.", "Drop the comparison."),
    ("CMP-DISPARAGE", "block", None, "disparage", _ALL, _ALL, {}, "Disparages {comp}: {term}.", "Talk about the house."),
    ("UK-FCA-ABSOLUTE", "block", None, "phrase", _ALL, ["UK"], {}, "Promises certainty: {terms}.", "Say what is protected."),
    ("UK-CREDIT-REP", "block", None, "phrase", _ALL, ["UK"], {"unless": "representative (?:example|apr)", "unlessScope": "text"}, "{terms} without a representative example.", "Add the example."),
    ("UK-FSCS", "block", None, "phrase", _ALL, ["UK"], {}, "Money is not covered so: {terms}.", "Say how it is safeguarded."),
    ("DE-ABSOLUTE", "block", None, "phrase", _ALL, ["DE"], {}, "Promises certainty: {terms}.", "State the term that holds."),
    ("DE-FREE", "warn", 12, "phrase", _ALL, ["DE"], {"unless": r"\*|zzgl|nur |für die ersten|for the first|then |after |danach|terms apply|agb|conditions", "unlessScope": "sentence"}, "{terms} without conditions.", "Name them beside it."),
    ("US-FREE", "warn", 12, "phrase", _ALL, ["US"], {"unless": r"\*|no credit card|terms apply|for the first|then \$|conditions|no strings", "unlessScope": "sentence"}, "{terms} without terms.", "State them beside it."),
    ("US-SUBSTANTIATION", "block", None, "phrase", _ALL, ["US"], {}, "Evidence implied: {terms}.", "Cite a register claim."),
    ("US-GUARANTEE", "warn", 12, "phrase", _ALL, ["US"], {}, "{terms} without its terms.", "Link them."),
    ("US-FDIC", "block", None, "phrase", _ALL, ["US"], {}, "Not a bank: {terms}.", "Remove it."),
    ("SEC-VAGUE", "warn", 12, "phrase", _ALL, _ALL, {}, "No evidence attached: {terms}.", "Say what is done."),
    ("SEC-ABSOLUTE", "block", None, "phrase", _ALL, _ALL, {}, "Absolute security: {terms}.", "Name the control."),
    ("SEC-CERT", "block", None, "cert", _ALL, _ALL, {}, "Certificate without evidence: {term}.", "File it first."),
]
_TERMS = {
    "TOV-HYPE": (*c.HYPE, "game chang*"),
    "TOV-PUSHY": (*c.PUSHY, "don’t miss out"),
    "CLM-SUPERLATIVE": (*c.SUPERLATIVES, "no 1", "nr. 1", "number 1"),
    "CMP-MENTION": ("Ledgerly", "SpendHive", "Pennant Pay", "Clearbook"),
    "CMP-COMPARE": (*c.COMPARISONS, "beats?", "vs."),
    "CMP-DISPARAGE": c.DISPARAGING,
    "UK-FCA-ABSOLUTE": c.ABSOLUTE["UK"],
    "UK-CREDIT-REP": ("interest", "interest-free", "apr"),
    "UK-FSCS": ("fscs*", "deposit protection", "protected up to"),
    "DE-ABSOLUTE": c.ABSOLUTE["DE"],
    "DE-FREE": ("kostenlos", "gratis", "umsonst", "free"),
    "US-FREE": ("free",),
    "US-SUBSTANTIATION": c.ABSOLUTE["US"],
    "US-GUARANTEE": ("guarantee*",),
    "US-FDIC": ("fdic*", "federally insured"),
    "SEC-VAGUE": (
        "bank-grade", "bank grade", "bank-level", "military-grade", "enterprise-grade", "gdpr compliant", "gdpr-compliant", "fully compliant",
    ),
    "SEC-ABSOLUTE": ("100% secure", "unhackable", "completely secure", "fully secure", "totally secure", "never be hacked"),
    # Capitals that are let off.
    "TOV-CAPS": (
        "GDPR", "SEPA", "IBAN", "HMRC", "FSCS", "FDIC", "DATEV", "CFO", "CFOS", "CEO", "VAT", "API", "ERP", "FCA", "FTC", "APR", "USD",
        "EUR", "GBP", "SOC", "PCI", "DSS", "ISO", "IEC", "SME", "SMES", "UWG", "AGB", "FAQ", "CSV", "SAAS", "B2B", "ATM", "AML", "KYC",
        "POS", "FERNWAY",
    ),
}
_CERTIFICATES = {"iso/iec 27001": "EV-060", "iso 27001": "EV-060", "soc 2": None, "soc2": None, "pci dss": None, "pci-dss": None}
_EVERYWHERE = ["UK", "DE", "US"]
_REGISTER = [
    ("EV-002", "Used by 40,000+ companies across Europe", [40000.0], None, _EVERYWHERE, None, None),
    ("EV-009", "Trusted by 25,000 companies", [25000.0], None, _EVERYWHERE, "superseded by EV-002", None),
    ("EV-014", "Save up to 10 hours a month on expense reports", [10.0], "up to", _EVERYWHERE, None, None),
    ("EV-021", "Cards issued in under 2 minutes", [2.0], "under", _EVERYWHERE, None, None),
    ("EV-027", "Receipts matched automatically in 92% of cases", [92.0], None, _EVERYWHERE, None, None),
    ("EV-033", "Spend in 30+ currencies with no FX markup", [30.0], None, _EVERYWHERE, None, None),
    ("EV-038", "Finance teams close the month 3 days faster on average", [3.0], "on average", _EVERYWHERE, None, None),
    ("EV-045", "1% cashback on card spend", [1.0], None, ["UK"], None, None),
    ("EV-052", "Cheaper than Ledgerly on list price for teams of 50 or more", [50.0], None, ["UK", "US"], None, "Ledgerly"),
    ("EV-060", "ISO/IEC 27001 certified", [], None, _EVERYWHERE, None, None),
]


@dataclass(frozen=True)
class Ruleset:
    """rules (RULE_SCHEMA, params a variant), terms (TERM_SCHEMA; of a `caps` rule: what is let off) and register
    (REGISTER_SCHEMA): policy tables, read from wherever they are kept. Nulls in channels or markets: all."""

    rules: DataFrame
    terms: DataFrame
    register: DataFrame

    @staticmethod
    def of(rules: DataFrame, terms: DataFrame, register: DataFrame) -> Ruleset:
        return Ruleset(rules.withColumn("params", F.parse_json("params")), terms, register)


def house(spark: SparkSession, custom: tuple[str, ...] = (), terms: dict[str, tuple[str, ...]] | None = None, register: list[tuple] | None = None) -> Ruleset:
    """The house's rules; custom: words that a team bans for itself; terms: other terms of some rules."""
    rules = [(k, *r[:6], json.dumps(r[6]), *r[7:]) for k, r in enumerate(_RULES)]
    known = {**_TERMS, "TOV-CUSTOM": tuple(w.strip() for w in custom if w.strip()), **(terms or {})}
    words = [(r, t, None) for r, ts in known.items() for t in ts] + [("SEC-CERT", t, e) for t, e in _CERTIFICATES.items()]
    entries = [(k, *r) for k, r in enumerate(_REGISTER if register is None else register)]
    return Ruleset.of(
        spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(words, TERM_SCHEMA), spark.createDataFrame(entries, REGISTER_SCHEMA)
    )
