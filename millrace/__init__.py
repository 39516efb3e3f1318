"""Account, session, request-log and corpus analytics as PySpark DataFrame operators."""
