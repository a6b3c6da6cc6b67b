"""quarry: Spark-native data engine for hypothetical-answer retrieval work.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark SQL expressions; Python runs inside tasks only where a user hook or an
order-dependent text fold needs it.
"""

from quarry.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
