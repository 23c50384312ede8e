"""Flows: graphs of sources, operators and cubes, checked as they are built and compiled to one lazy plan.

Schemas come from the analyzed plans, so a wrong column or type raises ``EngineSchemaError`` before anything runs.
Several edges into one node merge streams, whose schemas must be the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row

from rillcube.cube.cube import Cube, CubeQuery
from rillcube.cube.spec import CubeSpec
from rillcube.plans.degrade import Ladder, Policy
from rillcube.plans.registry import Operator, operator
from rillcube.schema import EngineSchemaError, same_schema
from rillcube.sources.sinks import client_rows


class Node:
    def __init__(self, flow: Flow, kind: str, name: str, make: Callable[[list], object]):
        self.flow, self.kind, self.name, self.make = flow, kind, name, make
        self.id = next(flow._ids)

    def __repr__(self) -> str:
        return f"{self.kind} {self.id} ({self.name})"


class Flow:
    def __init__(self):
        self._ids = count(1)
        self.nodes: dict[int, Node] = {}
        self.edges: list[tuple[int, int]] = []
        self.policies: list[Policy] = []

    def _add(self, node: Node) -> Node:
        self.nodes[node.id] = node
        return node

    def add_source(self, df: DataFrame, name: str = "source") -> Node:
        return self._add(Node(self, "source", name, lambda parts: df))

    def add_operator(self, name: str | Operator, ladder: Ladder | None = None, level: str = "level", **cfg) -> Node:
        """With a ladder, the operator's argument ``level`` is the step at which the ladder stands when the flow is built."""
        call = operator(name) if isinstance(name, str) else name
        label = name if isinstance(name, str) else getattr(name, "__name__", "operator")
        return self._add(Node(self, "operator", label, lambda parts: call(parts[0], **cfg, **({} if ladder is None else {level: ladder.current}))))

    def add_cube(self, spec: CubeSpec) -> Node:
        return self._add(Node(self, "cube", spec.name, lambda parts: Cube.build(spec, parts[0])))

    def add_query(self, query: CubeQuery = CubeQuery()) -> Node:
        """A subscriber that asks a cube once."""
        return self._add(Node(self, "query", "query", lambda parts: parts[0].query(query)))

    def connect(self, a: Node, b: Node) -> None:
        for n in (a, b):
            if self.nodes.get(n.id) is not n:
                raise EngineSchemaError(f"{n} is not in this flow")
        if b.kind == "source":
            raise EngineSchemaError("a source has no input")
        if (a.kind == "cube") != (b.kind == "query"):
            raise EngineSchemaError("a cube is read by queries, and queries read cubes")
        if (a.id, b.id) in self.edges or self._reaches(b.id, a.id):
            raise EngineSchemaError(f"the edge from {a} to {b} is there already or closes a circle")
        self.edges.append((a.id, b.id))

    def chain(self, nodes: Sequence[Node]) -> Node:
        for a, b in zip(nodes, nodes[1:]):
            self.connect(a, b)
        return nodes[-1]

    def remove(self, node: Node) -> None:
        self.nodes.pop(node.id, None)
        self.edges = [e for e in self.edges if node.id not in e]

    def add_policy(self, policy: Policy) -> None:
        self.policies.append(policy)

    def react(self, ratio: float, now: float) -> list[str]:
        """The ladders that moved when the policies saw a capacity ratio; plans that are built from then on are at the new steps."""
        return [moved for policy in self.policies if (moved := policy.react(ratio, now)) is not None]

    def inputs(self, node: Node) -> list[Node]:
        return [self.nodes[a] for a, b in self.edges if b == node.id]

    def outputs(self, node: Node) -> list[Node]:
        return [self.nodes[b] for a, b in self.edges if a == node.id]

    def sources(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.kind == "source"]

    def _reaches(self, a: int, b: int) -> bool:
        return a == b or any(self._reaches(y, b) for x, y in self.edges if x == a)

    def clone_back_from(self, node: Node, to: Sequence[DataFrame]) -> list[Node]:
        """The subgraph that leads to ``node``, once more for each table in ``to``, which stands for its source; the clones of ``node``."""
        out = []
        for df in to:
            made: dict[int, Node] = {}

            def copy(n: Node, df: DataFrame = df, made: dict[int, Node] = made) -> Node:
                if n.id not in made:
                    made[n.id] = self.add_source(df, n.name) if n.kind == "source" else self._add(Node(self, n.kind, n.name, n.make))
                    for before in self.inputs(n):
                        self.edges.append((copy(before).id, made[n.id].id))
                return made[n.id]

            out.append(copy(node))
        return out

    def connect_external(self, node: Node) -> Iterator[Row]:
        """The rows at a node, one by one, to a reader outside of the flow."""
        rows = self.build(node)
        return client_rows(rows.finalize() if isinstance(rows, Cube) else rows)

    def build(self, node: Node, _done: dict[int, object] | None = None):
        """The DataFrame (or, of a cube, the ``Cube``) at a node."""
        done = {} if _done is None else _done
        if node.id in done:
            return done[node.id]
        before = self.inputs(node)
        if node.kind != "source" and not before:
            raise EngineSchemaError(f"{node} has no input")
        parts = [self.build(n, done) for n in before]
        if len(parts) > 1:
            if node.kind == "query":
                parts = [Cube.merge(*parts)]
            else:
                same_schema(parts)
                whole = parts[0]
                for part in parts[1:]:
                    whole = whole.unionByName(part)
                parts = [whole]
        try:
            done[node.id] = node.make(parts)
        except (AnalysisException, TypeError) as e:
            raise EngineSchemaError(f"{node}: {e}") from e
        return done[node.id]

    def validate(self) -> dict[int, str]:
        """The schema at every node; raises at the first that is wrong."""
        if not self.nodes:
            raise EngineSchemaError("the flow has no operators")
        done: dict[int, object] = {}
        for node in self.nodes.values():
            self.build(node, done)
        return {i: (d.cells if isinstance(d, Cube) else d).schema.simpleString() for i, d in done.items()}
