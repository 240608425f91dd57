"""The entry drops the operators in silence if one cannot be imported; this says which one."""

from __future__ import annotations

import importlib
import pkgutil

import __spark_entry__
import colligo.llm
import pytest


@pytest.mark.parametrize("module", [*(f"colligo.llm.{m.name}" for m in pkgutil.iter_modules(colligo.llm.__path__)), "corpus_pipeline"])
def test_module_is_imported(module):
    importlib.import_module(module)


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
