import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from fixtures_llm import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny and long texts, copies, near copies, repeated passages, controls and non-ASCII."""
    a, b, c = prose(300, 1), prose(80, 2), prose(4000, 3)
    return [
        None, "", " \t\n\x0b ", "x", "a b c", a, a, a.replace("the", "teh", 2), b, b + " " + b, a + "\n" + b, c, "tail " + c[5000:9000] + " head",
        "word " * 400, "ab" * 900, "é" * 500 + " ü", "line\nline\n\nline\n", "\x00nul\x00 byte", "😀 " * 50, prose(30, 4), prose(30, 4), "<|endoftext|> x<|startoftext|>y", None, "",
        "ÉCOLE Straße ΣΑΣ İstanbul ﬁn é ́x don't we'll 12345 a b", " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(20, 90)),
    ]
