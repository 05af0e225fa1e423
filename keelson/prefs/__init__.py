"""Preference theories: the algebra that is worked out on the driver before a plan is made."""
