"""auditlake: document-conversion audits as Spark DataFrame queries."""
