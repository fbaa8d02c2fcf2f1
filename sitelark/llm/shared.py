"""The written tables of the library, under the name that the corpus operators know."""

from __future__ import annotations

from ..shared import deleted, dropped, fresh_path, shared_dir, written

__all__ = ["deleted", "dropped", "fresh_path", "shared_dir", "written"]
