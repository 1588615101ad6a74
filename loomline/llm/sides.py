"""Which side of a call a speaker label names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

AGENT, CUSTOMER = "agent", "customer"

#: Words for either side; the reference streams are mic for the agent and system for the customer (fixed values).
AGENT_WORDS = frozenset(
    "agent agt adviser advisor rep reps representative csr executive exec mic operator associate consultant officer telecaller "
    "salesperson helpdesk a एजेंट अभिकर्ता முகவர்".split()
)
CUSTOMER_WORDS = frozenset(
    "customer cust cus cstmr client caller policyholder policyowner insured member user system consumer subscriber buyer c ग्राहक வாடிக்கையாளர்".split()
)
_LONG = [(w, AGENT) for w in AGENT_WORDS if len(w) >= 5] + [(w, CUSTOMER) for w in CUSTOMER_WORDS if len(w) >= 6]


def _near(a: str, b: str) -> bool:
    """One letter more, less, other or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1 or a[0] != b[0]:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = (a[i + 1 :], b[i + 1 :])
    return rest[0] == rest[1] or a[i:] == rest[1] or rest[0] == b[i:] or (a[i + 1 : i + 2] == b[i : i + 1] and b[i + 1 : i + 2] == a[i : i + 1] and a[i + 2 :] == b[i + 2 :])


@lru_cache(maxsize=100_000)
def side(label: str | None) -> str | None:
    """``agent``, ``customer``, or None if the label names neither or both."""
    plain = unicodedata.normalize("NFKC", label or "").casefold()
    # marks belong to the letters of Indian scripts
    words = re.findall(r"[^\W\d_](?:[^\W\d_]|[ऀ-ൿ‌‍])*", plain)
    joined = "".join(words)
    named = {AGENT for w in words if w in AGENT_WORDS and (len(w) > 1 or w == joined)} | {CUSTOMER for w in words if w in CUSTOMER_WORDS and (len(w) > 1 or w == joined)}
    if joined in AGENT_WORDS or joined in CUSTOMER_WORDS:
        named = {AGENT if joined in AGENT_WORDS else CUSTOMER}
    if not named:
        named = {to for w in words if len(w) >= 4 for known, to in _LONG if _near(w, known)}
    return next(iter(named)) if len(named) == 1 else None
