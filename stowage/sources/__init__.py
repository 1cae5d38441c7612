"""Readers: file listings, archives, audit logs, manifests, scraped metrics."""
