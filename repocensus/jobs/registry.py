"""Every query of the library by name, with the SQL it must agree with."""

from __future__ import annotations

from . import census, code, inputs, relations, screens, streamed, written

QUERIES: dict = {**census.Q, **relations.Q, **screens.Q, **code.Q, **inputs.Q, **written.Q, **streamed.Q}
ORACLES: dict = {**census.SQL, **relations.SQL, **screens.SQL, **code.SQL, **inputs.SQL, **written.SQL, **streamed.SQL}
