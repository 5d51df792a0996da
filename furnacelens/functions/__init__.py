from furnacelens.functions.scalar import (  # noqa: F401
    clamp,
    finite_or,
    null_if_not_finite,
    r6,
    ramp,
    stable_hash,
    trunc_score,
    truthy_or,
    uniform01,
)
