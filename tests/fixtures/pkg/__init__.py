from .core import Base
