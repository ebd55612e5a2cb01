"""The example of the README runs, and what the README names exists."""

import importlib
import pathlib
import re

from tableprofile.plans.incidents import incidents
from tableprofile.sources import files

README = pathlib.Path(__file__).parent.parent / "README.md"


def test_example_runs(spark, folder, tmp_path):
    path = files.write_table(incidents(spark, folder), str(tmp_path / "incidents"), "csv")
    example = re.search(r"```python\n(.*?)```", README.read_text(encoding="utf-8"), re.S).group(1)
    names = {"spark": spark}
    exec(example.replace("/data/incidents", path), names)
    assert names["clean"].count() == incidents(spark, folder).count()
    assert set(names["known"]) == {"ipat", "a_o", "lat", "long", "edad", "costo"}


def test_named_functions_exist():
    table = README.read_text(encoding="utf-8").split("## Where the inventory is")[1].split("Not built")[0]
    modules = {}
    for package in ("functions", "operators", "sources"):
        modules[package] = importlib.import_module(f"tableprofile.{package}")
        for file in pathlib.Path(modules[package].__file__).parent.glob("[a-z]*.py"):
            modules[file.stem] = importlib.import_module(f"tableprofile.{package}.{file.stem}")
    named = re.findall(r"`(\w+)\.(\w+)[`(]", table)
    assert len(named) > 15
    for module, function in named:
        assert module == "SURVEY" or hasattr(modules[module], function), (module, function)
