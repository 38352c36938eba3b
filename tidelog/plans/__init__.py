"""Rules, predicates, publications and subscriptions that become plans."""
