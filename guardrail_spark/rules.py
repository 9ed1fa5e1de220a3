"""Rule packs as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One detection rule. kind: pii or secrets. gate: a plain pattern that every match contains; texts without it are not
    searched with the rule's own, dearer one."""

    id: str
    regex: str
    confidence: float
    kind: str
    keywords: tuple[str, ...] = ()
    context_words: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    entropy_min: float = 0.0
    requires_context: bool = False
    gate: str = ""


def rule_pack(spec: dict) -> list[Rule]:
    """Rules of a pack given as plain data: {'kind': .., 'rules'|'entities': [..]}; missing fields get the pack's defaults."""
    out = []
    for r in spec.get("entities") or spec.get("rules") or []:
        pii = "label" in r
        out.append(
            Rule(
                id=r.get("label") or r["id"], regex=r["regex"], kind="pii" if pii else "secrets",
                confidence=float(r.get("base_confidence", 0.5) if pii else r.get("confidence", 0.5)),
                keywords=tuple(r.get("keywords", ())), context_words=tuple(w.lower() for w in r.get("context_words", ())),
                validators=tuple(r.get("validators", ())), entropy_min=float(r.get("entropy_min", 0.0)),
                requires_context=bool(r.get("requires_context", False)),
            )
        )
    return out


# Patterns, context words and confidences of the financial entity pack.
PII = [
    Rule("SSN", r"(?<!\d)(?!000|666|9\d\d)\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}(?!\d)", 0.75, "pii", context_words=("ssn", "social security", "social sec", "ss#", "tin"), gate=r"\d{3}[- ]?\d{2}[- ]?\d{4}"),
    Rule("CREDIT_CARD", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", 0.55, "pii", context_words=("card", "visa", "mastercard", "amex", "discover", "pan", "cvv", "cvc"), validators=("luhn",), gate=r"\d(?:[ -]?\d){12}"),
    Rule("US_ROUTING", r"(?<!\d)(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)\d{7}(?!\d)", 0.60, "pii", context_words=("routing", "aba", "routing number", "rtn"), validators=("aba_checksum",), gate=r"\d{9}"),
    Rule("US_BANK_ACCOUNT", r"(?<!\d)\d{6,17}(?!\d)", 0.30, "pii", context_words=("account", "acct", "account number", "acct#"), requires_context=True, gate=r"\d{6}"),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){10,30}\b", 0.75, "pii", context_words=("iban",), validators=("iban_checksum",), gate=r"[A-Z]{2}\d{2}"),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.90, "pii", gate=r"@"),
    Rule("US_PHONE", r"(?<!\d)(?:\+?1[-. ]?)?\(?[2-9]\d{2}\)?[-. ]?[2-9]\d{2}[-. ]?\d{4}(?!\d)", 0.75, "pii", context_words=("phone", "tel", "mobile", "cell", "contact"), gate=r"\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}"),
]
PII_PACK = "financial-us@2.1"

# The core secret rules.
SECRETS = [
    Rule("aws-access-key", r"\b(AKIA|ASIA|AGPA|AROA|AIDA|ANPA|ANVA|APKA)[A-Z0-9]{16}\b", 0.98, "secrets", ("AKIA", "ASIA", "AGPA", "AROA", "AIDA", "ANPA", "ANVA", "APKA")),
    Rule("aws-secret-key", r"(?i)aws.{0,30}(secret|access)?[_-]?key['\"]?\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?", 0.90, "secrets", ("aws",)),
    Rule("github-pat", r"\bghp_[A-Za-z0-9]{36}\b", 0.99, "secrets", ("ghp_",)),
    Rule("github-oauth", r"\bgho_[A-Za-z0-9]{36}\b", 0.99, "secrets", ("gho_",)),
    Rule("github-app-token", r"\b(ghs_|ghu_)[A-Za-z0-9]{36}\b", 0.99, "secrets", ("ghs_", "ghu_")),
    Rule("slack-token", r"\bxox[baprs]-[A-Za-z0-9-]{10,72}\b", 0.98, "secrets", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("stripe-secret", r"\bsk_(live|test)_[A-Za-z0-9]{24,}\b", 0.99, "secrets", ("sk_live_", "sk_test_")),
    Rule("google-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b", 0.95, "secrets", ("AIza",)),
    Rule("openai-api-key", r"\bsk-[A-Za-z0-9]{32,}\b", 0.90, "secrets", ("sk-",)),
    Rule("jwt", r"\bey[A-Za-z0-9_-]{10,}\.ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0.85, "secrets", ("ey",), validators=("jwt_structural",), gate=r"ey[A-Za-z0-9_-]{10,}+\.ey"),
    Rule("private-key-pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----", 1.0, "secrets", ("BEGIN",)),
    Rule("generic-high-entropy", r"\b[A-Za-z0-9+/=_-]{24,}\b", 0.55, "secrets", entropy_min=4.5, gate=r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24}"),
]
#: A rule that the feed adds; it fires on the test tables.
TOKEN_RULE = Rule("token-assignment", r'token = "[0-9a-f]{40}"', 0.95, "secrets", ("token",))

# Rules that a feed adds to the core ones.
FEED_RULES = [
    Rule("clickhouse-cloud-key", r"\bch_[a-zA-Z0-9]{32,}\b", 0.95, "secrets", ("ch_",)),
    Rule("linear-api-key", r"\blin_api_[a-zA-Z0-9]{40,}\b", 0.95, "secrets", ("lin_api_",)),
    Rule("supabase-service-role", r"\bsb_secret_[A-Za-z0-9_]{20,}\b", 0.90, "secrets", ("sb_secret_",)),
]

# The codes of the safety model, and the categories that a judge is asked for.
SAFETY_CODES = {
    "S1": "Violent Crimes", "S2": "Non-Violent Crimes", "S3": "Sex-Related Crimes", "S4": "Child Sexual Exploitation", "S5": "Defamation",
    "S6": "Specialized Advice (financial / medical / legal)", "S7": "Privacy", "S8": "Intellectual Property", "S9": "Indiscriminate Weapons",
    "S10": "Hate", "S11": "Suicide & Self-Harm", "S12": "Sexual Content", "S13": "Elections", "S14": "Code Interpreter Abuse",
}
SAFETY_CATEGORIES = {
    "violence": "Violence & threats of physical harm",
    "self_harm": "Self-harm / suicide encouragement",
    "sexual": "Sexual content involving minors OR non-consensual acts",
    "hate": "Hate speech / harassment against protected classes",
    "weapons": "Illicit weapons manufacture / procurement",
    "illegal": "Instructions to commit crimes / illegal drugs / fraud",
    "privacy": "Doxing / personally-identifying data disclosure",
    "professional": "Unqualified professional advice (medical/legal/financial) framed as authoritative",
}

# Needles of the first safety layer, in order of precedence.
HARD_SIGNALS = {
    "self_harm": ["how to end my life", "kill myself"],
    "weapons": ["how to build a pipe bomb", "how to make a bomb"],
    "illegal": ["how to launder money", "how to commit fraud"],
}
HARD_SCORE = 0.95

# Abbreviations that don't end a sentence, and words that make a clause a claim.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "sr.", "jr.", "st.", "u.s.", "u.k.", "e.g.", "i.e.", "etc.", "vs.", "no.", "fig.", "inc.", "ltd.")
AUXILIARIES = "is|are|was|were|has|have|had|does|do|did|will|would|can|could|may|might|shall|should|must|be|been|being"
