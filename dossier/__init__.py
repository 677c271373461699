"""dossier: document-ledger analytics as lazy Spark DataFrame operators."""
