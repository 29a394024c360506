from __future__ import annotations

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent / "tidemark"


def test_nothing_outside_imports_llm():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"tidemark\.llm|from tidemark import llm", p.read_text()), p


def test_no_local_checkpoints():
    assert not any("localCheckpoint" in p.read_text() for p in ROOT.rglob("*.py"))
