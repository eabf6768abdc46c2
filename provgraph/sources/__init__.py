"""Readers of audit logs, graph files, labels and the driver's tables; writers of reports and stores."""
