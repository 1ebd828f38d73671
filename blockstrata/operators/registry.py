"""Registries of block states and biomes: dimensions of one game version, small enough to send along."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

NAMESPACE = "minecraft:"
#: Order of a boolean state's values: fixed by the game's format.
BOOLEANS = ("true", "false")


@dataclass
class Block:
    name: str
    default_state: int
    min_state: int
    states: list[tuple[str, list[str]]] = field(default_factory=list)  # (name, values), the last counts least

    @property
    def size(self) -> int:
        n = 1
        for _, values in self.states:
            n *= len(values)
        return n


class Registry:
    """Looked up once per palette entry, not per cell. Unknown names and ids are errors."""

    def __init__(self, version: str, blocks: list[Block], biomes: dict[str, int]):
        self.version, self.blocks, self.biomes = version, {b.name: b for b in blocks}, biomes
        if any(not 0 <= b.min_state or b.min_state + b.size > 65536 for b in blocks) or any(not 0 <= i < 256 for i in biomes.values()):
            raise ValueError("state ids are 16 bits wide, biome ids 8")
        self.biome_names = {i: n for n, i in biomes.items()}
        self._by_id = {b.min_state + i: b for b in blocks for i in range(b.size)}

    @classmethod
    def from_json(cls, text: str) -> Registry:
        """Fields version, blocks (name, default_state, min_state_id, states of name, type, values) and biomes (id, name)."""
        raw = json.loads(text)
        of = lambda s: list(BOOLEANS) if s.get("type") == "bool" else list(s["values"])
        blocks = [Block(b["name"], b["default_state"], b.get("min_state_id", b["default_state"]), [(s["name"], of(s)) for s in b.get("states") or []]) for b in raw["blocks"]]
        return cls(raw["version"], blocks, {b["name"]: b["id"] for b in raw["biomes"]})

    def state_id(self, name: str, props: dict[str, str]) -> int:
        block = self.blocks.get(name.removeprefix(NAMESPACE))
        if block is None:
            raise KeyError(f"unknown block {name}")
        if not props or not block.states:
            return block.default_state
        number = 0
        for state, values in block.states:
            if props.get(state) not in values:
                raise ValueError(f"{name}: {state} is {props.get(state)}, not one of {values}")
            number = number * len(values) + values.index(props[state])
        return block.min_state + number

    def state(self, number: int) -> tuple[str, list[tuple[str, str]]]:
        """(name, properties, the last state first)."""
        block = self._by_id.get(number)
        if block is None:
            raise KeyError(f"unknown block state {number}")
        rest, props = number - block.min_state, []
        for state, values in reversed(block.states):
            rest, digit = divmod(rest, len(values))
            props.append((state, values[digit]))
        return block.name, props

    def biome_id(self, name: str) -> int:
        if name.removeprefix(NAMESPACE) not in self.biomes:
            raise KeyError(f"unknown biome {name}")
        return self.biomes[name.removeprefix(NAMESPACE)]

    def biome_name(self, number: int) -> str:
        if number not in self.biome_names:
            raise KeyError(f"unknown biome {number}")
        return self.biome_names[number]

    def block_states(self, spark: SparkSession) -> DataFrame:
        """block_state_dim: version, state_id, name, props."""
        rows = [(self.version, i, b.name, self.state(i)[1]) for i, b in sorted(self._by_id.items())]
        return spark.createDataFrame(rows, "mc_version string, state_id int, name string, props array<struct<k:string,v:string>>")

    def biome_dim(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, i, n) for n, i in self.biomes.items()], "mc_version string, id int, name string")
