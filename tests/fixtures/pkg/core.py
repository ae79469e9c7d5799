"""Core."""
import os
import a.b
import a.b as c
from . import sub
from ..other import y as z
from m import *
from m2 import *


def helper(x: int, *args, k=1) -> str:
    return os.path.join(x)


@decorate(1)
@plain
class Base:
    """Base doc."""

    def ping(self):
        return self.pong()

    def pong(self):
        return helper(1)

    class Inner:
        def deep(self):
            pass


if True:
    def guarded():
        v = Base()
        v.ping()

        def nested():
            helper(2)
        return v
