"""Small corpora with every odd case, and brute-force readings of the contracts."""

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (f"{r.randrange(60)}" if r.random() < 0.7 else "") for _ in range(n))


def edited(text, seed, every):
    r = random.Random(seed)
    w = text.split()
    for i in range(0, len(w), every):
        w[min(len(w) - 1, i + r.randrange(every))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def documents():
    base = prose(1, 120)
    texts = [base, base, base.upper(), edited(base, 3, 30), edited(edited(base, 3, 30), 4, 40), edited(base, 5, 6), prose(2, 300), prose(2, 300) + "\n", None, "", "  \t\n", "one", "one two", "One\tTWO", "ünïcode Ünïcode é 東京 ΑΣ", prose(7, 5000), "word " * 4000, "a b c d", "A B C D", "!!! ### $$$ " * 20]
    texts += [edited(base, 100 + i, 25) for i in range(12)] + [prose(50 + i, 40) for i in range(12)]
    rows = [(i, t, "en" if i % 3 else None, [None, "s1", "s2", "S3", ""][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, base, "en", "s1", 3), (None, None, None, None, None)]


def with_clashes(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["size", "component_id", "node", "_key", "_size", "_turn", "_spans", "_doc", "_gone", "_score", "part", "score", "source_key", "taken", "KEPT"]
    return df.withColumns({n: F.lit(1) for n in names})
