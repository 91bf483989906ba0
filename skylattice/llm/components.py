"""Connected components, lineage cuts and the shared folder, as the rest of the library has them."""

from ..operators.graph import components, cut, discard, shared_folder

__all__ = ["components", "cut", "discard", "shared_folder"]
