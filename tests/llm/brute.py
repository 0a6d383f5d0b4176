"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def word_repeats(docs, window=20):
    """docs: [(doc_id, text)]. {doc_id: (n_words, n_removed, kept)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), " ".join(kept))
    return out


def byte_repeats(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        own = set()
        for i in range(len(b) - window + 1):
            key = b[i : i + window]
            own.add(key)
            if key in seen:
                gone[i : i + window] = b"\1" * window
        seen |= own
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
