"""External services: contracts and deterministic stand-ins."""
