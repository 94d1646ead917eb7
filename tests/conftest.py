from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from scriptorium.plans.index import Index
from scriptorium.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


#: Ten files to index, two of them below three folders, and four that are left out.
FILES = {
    "garden/beds/2021/asparagus.md": "# Asparagus bed\n\nTrench dug in March, compost below. Crème fraîche goes well with it.\n",
    "garden/beds/2022/beans.txt": "Title: Runner beans\nURL: https://example.org/beans\n\n"
    "Sown late. Slugs came, copper tape helped: more copper tape in June.\n",
    "garden/pests.md": "Slugs and aphids\n\nCopper around the pots, tape on the rims.\n",
    "garden/_drafts/pond.txt": "A pond needs liner, stones and patience.\n",
    "kitchen/Soups/leek.txt": "title: Leek soup\n\nLeeks, potatoes, stock and saffron.\n",
    "kitchen/Soups/saffron.md": "- shopping\n\n## Saffron broth\n\nnothing else in it\n",
    "kitchen/bread.TXT": "flour-water-salt, no header\n",
    "_inbox.txt": "unsorted: copper kettle\n",
    "empty.md": "",
    "notes/a b (c) & d.md": "half-done list\n",
    "kitchen/photo.jpg": "copper",
    ".trash/old.txt": "copper",
    "garden/__pycache__/x.md": "copper",
    "notes/.draft.md": "copper",
}


def write_tree(root: Path, files: dict[str, str | bytes]) -> Path:
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return root


@pytest.fixture
def corpus(tmp_path: Path) -> Path:
    return write_tree(tmp_path / "corpus", FILES)


@pytest.fixture(scope="module")
def fixed(spark, tmp_path_factory) -> Index:
    """An index that tests only read."""
    base = tmp_path_factory.mktemp("fixed")
    index = Index(spark, str(base / "index"))
    index.update(str(write_tree(base / "corpus", FILES)))
    index.create_tags(["outdoors", "cooking"])
    index.apply_tag("outdoors", under="Garden")
    index.apply_tag("cooking", ["kitchen/Soups/leek.txt", "kitchen/Soups/saffron.md"])
    return index


def paths(frame) -> list[str]:
    return [r["path"] for r in frame.collect()]
