"""The scoring expressions on a stream of requests."""
