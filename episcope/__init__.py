"""episcope — Spark-native operators for disease-surveillance analytics.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing inside an operator calls ``collect`` or ``count``. Compose
them with ``df.transform(op)``.
"""

from episcope.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
