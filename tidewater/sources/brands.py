"""Brands that were added by machine, in numbered versions of one small file.

Each version is written whole under the next number by a rename that fails if the number is taken, so that
two writers at once lose nothing: the second reads again and adds to what the first wrote. The text is JSON,
which every YAML reader takes too. Names are equal regardless of case and of white space at their ends.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidewater.operators.tables import Conflict, Folder
from tidewater.sources.config import merge_brands


class BrandFile:
    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def _newest(self) -> tuple[int, list[dict]]:
        held = [n for n in self.folder.names() if n.startswith("brands-")]
        if not held:
            return 0, []
        number = int(held[-1].removeprefix("brands-").removesuffix(".yml"))
        try:
            return number, list(json.loads(self.folder.text(held[-1])).get("brands") or [])
        except (ValueError, AttributeError):
            return number, []  # a file that can't be read is begun anew

    def read(self, *before: list[dict]) -> list[dict]:
        """The brands, after those of other lists; the first of equal names wins."""
        return merge_brands(*before, self._newest()[1])

    def add(self, entry: dict, tries: int = 20) -> bool:
        """Append a brand; False if it is known already."""
        name = " ".join(str(entry.get("name") or "").split())
        if not name:
            raise ValueError("a brand needs a name")
        for _ in range(tries):
            number, brands = self._newest()
            if any(str(b.get("name", "")).strip().lower() == name.lower() for b in brands):
                return False
            text = json.dumps({"brands": [*brands, entry | {"name": name}]}, ensure_ascii=False, indent=1)
            if self.folder.put(f"brands-{number + 1:06d}.yml", text):
                return True
        raise Conflict(f"other writers came first {tries} times")
