"""Key -> DuckDB SQL for the differential check (see ``textctl.oracle``)."""

from __future__ import annotations

from .. import oracle as O

ORACLE = O.build()
