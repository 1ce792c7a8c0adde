"""Web-audit, lead and outreach analytics as DataFrame and Structured Streaming operators."""
