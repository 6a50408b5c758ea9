"""DataFrame operators. None of them runs an action; time-dependent ones take ``as_of``."""
