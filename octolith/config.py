"""Parameters of the tree and of a view."""

from __future__ import annotations


from dataclasses import dataclass, field

LATTICE_BITS = 28  #: bits per axis of the finest lattice
MAX_DEPTH = 20


@dataclass(frozen=True)
class TreeConfig:
    """A node with more than ``max_points`` points splits, down to ``max_depth``; inner nodes own ``grid``^3 voxels."""

    max_points: int = 50_000
    max_depth: int = MAX_DEPTH
    grid: int = 128
    chunk: int = 1000

    def __post_init__(self) -> None:
        if self.grid & (self.grid - 1) or self.grid < 1:
            raise ValueError("grid must be a power of two")
        if not 0 <= self.max_depth <= min(MAX_DEPTH, LATTICE_BITS - self.grid_bits):
            raise ValueError("the lattice is too coarse for this depth and grid")
        if self.max_points < 1 or self.chunk < 1:
            raise ValueError("max_points and chunk must be positive")

    @property
    def grid_bits(self) -> int:
        return self.grid.bit_length() - 1


@dataclass(frozen=True)
class Cube:
    """The root node's box: a cube whose edge is the longest edge of the data."""

    x: float = 0.0
    y: float = 0.0
    z: float = 0.0
    size: float = 1.0

    @staticmethod
    def around(low: tuple[float, float, float], high: tuple[float, float, float]) -> Cube:
        size = max(b - a for a, b in zip(low, high, strict=True))
        return Cube(*map(float, low), float(size) if size > 0 else 1.0)


Matrix = tuple[tuple[float, float, float, float], ...]
IDENTITY: Matrix = ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0), (0, 0, 0, 1.0))


@dataclass(frozen=True)
class View:
    """World-to-clip matrix (rows), viewport and drawing options.

    ``update`` is the matrix that decides what is visible; it stays behind when the view is frozen.
    """

    transform: Matrix = IDENTITY
    width: int = 64
    height: int = 64
    min_node_size: float = 64.0
    point_size: int = 1
    color_mode: str = "rgb"  #: rgb, node or lod
    update: Matrix | None = field(default=None)

    @property
    def update_transform(self) -> Matrix:
        return self.update or self.transform

    def frozen(self, transform: Matrix) -> View:
        """The same visible set, seen by another matrix."""
        return View(transform, self.width, self.height, self.min_node_size, self.point_size, self.color_mode, self.update_transform)


